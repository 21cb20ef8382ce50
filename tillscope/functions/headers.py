"""Header names."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence


def snake_case(name: str) -> str:
    """``Gross Sales`` -> ``gross_sales``: the runs of letters and digits, joined by ``_``."""
    return "_".join(re.findall("[0-9a-z]+", name.lower()))


def snake_case_all(names: Sequence[str]) -> list[str]:
    """Snake-case every header; two headers that become one name are an error."""
    sources = defaultdict(list)
    for name in names:
        sources[snake_case(name)].append(name)
    clashes = {target: found for target, found in sources.items() if len(found) > 1}
    if clashes:
        raise ValueError(f"headers collide after normalisation: {clashes}")
    return [snake_case(name) for name in names]
