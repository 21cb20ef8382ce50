"""Templates of the licence scan: notices, headers, titles and short texts of common licences.

Families that differ in names and versions only are made by rule.  Each template is
(licence, text, needs): ``needs`` are groups of terms, and a passage is like the template
only if it holds a term of every group.  They tell versions and kinds apart where the
rest of the words is the same.
"""

from __future__ import annotations

import re

# A term of a passage: a run of letters, or a number.
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)?"
# Words that say nothing about a licence are no terms.
STOP_WORDS = (
    "the of and to a in is it for on as with that this be are by or at an not from but all you may any no if have has was "
    "its can will so do more one out such other should must see your their they we our he she his her which when there"
).split()

Template = tuple[str, str, tuple[tuple[str, ...], ...]]

# The licences' own words.
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
)
APACHE_REST = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. "
)
ISC_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means."
)
# Name in the family, its words, version, date of the title.
GNU = [
    ("GPL", "General Public License", "2", "June 1991"),
    ("GPL", "General Public License", "3", "29 June 2007"),
    ("LGPL", "Lesser General Public License", "2.1", "February 1999"),
    ("LGPL", "Lesser General Public License", "3", "29 June 2007"),
    ("AGPL", "Affero General Public License", "3", "19 November 2007"),
]
CC_KINDS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = ("4.0", "3.0", "2.0")
GNU_WORDS = {"GPL": ("gpl", "gplv", "general"), "LGPL": ("lgpl", "lgplv", "lesser"), "AGPL": ("agpl", "agplv", "affero")}

# A short notice names the licence and says that it is one; the name alone may be a word of another language.
SAYS_LICENSE = ("license", "licence", "licensed", "licenses", "licensing")


def _version(number: str) -> tuple[str, ...]:
    return (number,) if "." in number else (number, f"{number}.0")


def _gnu() -> list[Template]:
    rows: list[Template] = []
    for short, words, number, date in GNU:
        name = f"{short}-{number if '.' in number else number + '.0'}"
        needs = (GNU_WORDS[short], _version(number))
        grant = (
            f"is free software; you can redistribute it and/or modify it under the terms of the GNU {words} as published "
            f"by the Free Software Foundation; either version {number} of the License, or (at your option) any later version. "
        )
        rest = (
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
            f"GNU {words} for more details. You should have received a copy of the GNU {words} along with this program."
        )
        texts = [
            f"This work is licensed under the GNU {words}, version {number}",
            f"Licensed under the GNU {words} version {number}",
            f"This program {grant}",
            f"This program {grant}{rest}",
            f"GNU {words} Version {number}, {date}",
            f"GNU {words} Version {number}, {date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy "
            "and distribute verbatim copies of this license document, but changing it is not allowed.",
            f"Licensed under the {short} version {number}",
            f"Released under the {short}v{number} license",
        ]
        rows += [(name, text, needs) for text in texts]
    return rows


def _creative_commons() -> list[Template]:
    rows: list[Template] = []
    for version in CC_VERSIONS:
        for kind, words in CC_KINDS.items():
            name, needs = f"CC-{kind}-{version}", ((version,),)
            rows += [
                (name, f"Licensed under CC {kind} {version}", needs),
                (name, f"This work is licensed under a Creative Commons {words} {version} International License", needs),
            ]
    return rows


def _single() -> list[Template]:
    apache, mpl = (("apache",), ("2", "2.0")), (("mozilla", "mpl"), ("2", "2.0"))
    return [
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0", apache),
        ("Apache-2.0", "Released under the Apache License 2.0", apache),
        ("Apache-2.0", APACHE, apache),
        ("Apache-2.0", APACHE + APACHE_REST, apache),
        ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", apache),
        ("MIT", "Released under the MIT License", (("mit",), SAYS_LICENSE)),
        ("MIT", "Licensed under the MIT License", (("mit",), SAYS_LICENSE)),
        ("MIT", "The MIT License (MIT)", (("mit",), SAYS_LICENSE)),
        ("MIT", MIT_GRANT, ()),
        ("MIT", MIT_GRANT + MIT_REST, (("sublicense",),)),
        ("ISC", "Licensed under the ISC License", (("isc",), SAYS_LICENSE)),
        ("ISC", ISC, (("fee",),)),
        ("ISC", ISC + ISC_REST, (("fee",),)),
        (
            "BSD-3-Clause",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
            (("bsd",),),
        ),
        ("BSD-2-Clause", "Licensed under the BSD 2-Clause License", (("bsd",), ("2",))),
        ("BSD-3-Clause", "Licensed under the BSD 3-Clause License", (("bsd",), ("3",))),
        ("BSD-2-Clause", BSD_GRANT + BSD_REST, ()),
        ("BSD-3-Clause", BSD_GRANT + BSD_NAMES + BSD_REST, (("neither", "endorse"),)),
        ("MPL-2.0", MPL, mpl),
        ("MPL-2.0", "Mozilla Public License Version 2.0", mpl),
        ("Unlicense", UNLICENSE, (("unencumbered",),)),
        ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", (("cc",), ("0",))),
    ]


def _spdx(names: list[str]) -> list[Template]:
    """Lines with an identifier; those of GNU licences may say whether later versions hold too."""
    rows: list[Template] = []
    for name in names:
        needs = (("spdx",), *((term,) for term in dict.fromkeys(re.findall(TERM, name.lower())) if term not in STOP_WORDS))
        for end in ("", "-only", "-or-later") if name.partition("-")[0] in GNU_WORDS else ("",):
            rows.append((name, f"SPDX-License-Identifier: {name}{end}", needs))
    return rows


def common_licenses() -> list[Template]:
    """All templates; of equally like ones the earlier wins."""
    rows = _single() + _gnu() + _creative_commons()
    named = list(dict.fromkeys(name for name, _, _ in rows))
    return rows + _spdx(named)
