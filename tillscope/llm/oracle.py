"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from tillscope.llm.chat_format import EXTRA_TEXT
from tillscope.llm.license_notices import STOP_WORDS, TERM
from tillscope.llm.licenses import EMPTY_LINES, LIKE, SENTENCE_END, TEMPLATES, needed_bits
from tillscope.llm.token_counts import VERSIONS

_COUNTED = " UNION ALL ".join(
    f"SELECT source, lang, '{name}' AS version, len(regexp_extract_all(text, '{pattern}')) AS tokens FROM kept"
    for name, pattern in VERSIONS.items()
)

TOKEN_COUNTS_SQL = rf"""
WITH marked AS (
  SELECT source, lang, coalesce(text, '') AS text,
         EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 1) AS toxic,
         EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 0) AS low
  FROM documents
), kept AS (
  SELECT source, lang, CASE WHEN toxic THEN regexp_replace(text, '[0-9]+', '', 'g') ELSE text END AS text
  FROM marked WHERE toxic OR NOT low
), counted AS ({_COUNTED})
SELECT source, lang, version, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens
FROM counted GROUP BY source, lang, version
"""

_TEMPLATES = ", ".join(
    f"({i}, '{name}', '{text}', {(1 << len(needs)) - 1})" for i, (name, text, needs) in enumerate(TEMPLATES)
)
_NEEDS = ", ".join(
    f"({i}, '{term}', {bits})" for i, (_, _, needs) in enumerate(TEMPLATES) for term, bits in needed_bits(needs).items()
)
_STOP = ", ".join(f"'{word}'" for word in STOP_WORDS)
_SIGNAL = "(?i)licen[cs]|copyright|spdx|warrant|redistribut"

LICENSES_SQL = rf"""
WITH templates(number, name, notice, wanted) AS (VALUES {_TEMPLATES}),
needs(number, term, bits) AS (VALUES {_NEEDS}),
template_terms AS (
  SELECT number, term, count(*) AS n
  FROM (SELECT number, unnest(regexp_extract_all(lower(notice), '{TERM}')) AS term FROM templates)
  WHERE term NOT IN ({_STOP})
  GROUP BY number, term
), rarity AS (
  SELECT term, ln((1 + {len(TEMPLATES)}) / (1 + count(*))) + 1 AS rarity FROM template_terms GROUP BY term
), template_norms AS (
  SELECT number, sqrt(sum(pow((1 + ln(n)) * rarity, 2))) AS norm FROM template_terms JOIN rarity USING (term)
  GROUP BY number
), parts AS (
  SELECT number, term, (1 + ln(n)) * rarity / norm AS part
  FROM template_terms JOIN rarity USING (term) JOIN template_norms USING (number)
), files AS (
  SELECT doc_id, text,
         concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR),
           CASE WHEN (doc_id // 100) % 5 <> 0 THEN CAST(doc_id // 100 AS VARCHAR) END,
           CASE WHEN regexp_matches(string_split(text, chr(10))[1], '{_SIGNAL}')
                  OR regexp_matches(string_split(text, chr(10))[-1], '{_SIGNAL}')
                THEN concat('LICENSE-', doc_id) ELSE concat(doc_id, '.txt') END) AS path
  FROM documents
), blocks AS (
  SELECT doc_id, unnest(string_split_regex(lower(text), '{EMPTY_LINES}')) AS block FROM files
), passages AS (
  SELECT doc_id, unnest(list_distinct(list_concat([block], string_split(block, chr(10)),
    string_split(regexp_replace(block, '{SENTENCE_END}', '\1' || chr(1) || '\2', 'g'), chr(1))))) AS passage FROM blocks
  UNION ALL
  SELECT doc_id, lower(text) FROM files WHERE regexp_matches(path, '(^|/)LICENSE[^/]*$')
), terms AS (
  SELECT passage, term, count(*) AS n
  FROM (SELECT passage, unnest(regexp_extract_all(passage, '{TERM}')) AS term FROM (SELECT DISTINCT passage FROM passages))
  WHERE term NOT IN ({_STOP})
  GROUP BY passage, term
), weighted AS (
  SELECT passage, term, (1 + ln(n)) * coalesce(rarity, ln(1 + {len(TEMPLATES)}) + 1) AS weight
  FROM terms LEFT JOIN rarity USING (term)
), norms AS (
  SELECT passage, sqrt(sum(weight * weight)) AS norm FROM weighted GROUP BY passage
), cosines AS (
  SELECT passage, number, round(sum(weight * part) / any_value(norm), 6) AS cosine
  FROM weighted JOIN parts USING (term) JOIN norms USING (passage) GROUP BY passage, number
  HAVING cosine >= {LIKE}
), met AS (
  SELECT passage, number, bit_or(bits) AS met
  FROM cosines JOIN needs USING (number) JOIN terms USING (passage, term) GROUP BY passage, number
), fitting AS (
  SELECT passage, number, cosine FROM cosines JOIN templates USING (number) LEFT JOIN met USING (passage, number)
  WHERE coalesce(met, 0) = wanted
), own AS (
  SELECT doc_id, number, cosine FROM passages JOIN fitting USING (passage)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, number) = 1
), known AS (
  SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, number, cosine
  FROM files LEFT JOIN own USING (doc_id)
), speaking AS (
  SELECT directory AS above, number, cosine FROM known
  WHERE number IS NOT NULL AND regexp_matches(path, '(^|/)LICENSE[^/]*$')
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, number) = 1
), nearest AS (
  SELECT d.directory, s.above, s.number AS above_number, s.cosine AS above_cosine
  FROM (SELECT DISTINCT directory FROM known) d
  JOIN speaking s ON d.directory = s.above OR starts_with(d.directory, s.above || '/')
  QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(s.above) DESC) = 1
)
SELECT doc_id, path, name AS license,
       CASE WHEN known.number IS NOT NULL THEN 'header' WHEN above IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       coalesce(cosine, above_cosine) AS cosine,
       CASE WHEN known.number IS NULL THEN above END AS from_directory
FROM known LEFT JOIN nearest USING (directory)
LEFT JOIN templates ON templates.number = coalesce(known.number, above_number)
"""

_ORDER = "ORDER BY turn NULLS FIRST, role, text"

CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{EXTRA_TEXT}'), (-7, 1, 'assistant', '{EXTRA_TEXT}')
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id {_ORDER}) IS DISTINCT FROM role AS opens,
         replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS mark,
         len(regexp_extract_all(text, '<\\*(turn |/turn>|next>)')) AS quoted
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' {_ORDER})) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + quoted + CASE WHEN opens THEN 15 + length(mark) ELSE 6 END) AS BIGINT) AS formatted_chars,
       count(*) FILTER (opens) AS n_blocks
FROM marked GROUP BY conv_id
"""

_BLANK = r"\x20\x09-\x0D"

FILL_MIDDLE_SQL = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS digest,
         regexp_extract_all(coalesce(text, ''), '[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+') AS units
  FROM documents
), hashed AS (
  SELECT *, len(units) AS n, {", ".join(f"CAST(concat('0x', substr(digest, {8 * i + 1}, 8)) AS BIGINT) AS h{i + 1}" for i in range(4))}
  FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parted AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:n], '') AS suffix
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle)
              ELSE concat('<P>', prefix, '<S>', suffix, '<M>', middle) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""
