"""Queries of this subpackage for the driver's contract."""

from __future__ import annotations

from inkstrata.llm.decontaminate import op5_winnowing
from inkstrata.llm.embedding_dedup import op6_embeddings
from inkstrata.llm.html_render import op4_html
from inkstrata.llm.katz import op8_katz
from inkstrata.llm.licenses import op12_licenses
from inkstrata.llm.packing import op1_packing
from inkstrata.llm.pii import op7_pii
from inkstrata.llm.quality import op2_quality
from inkstrata.llm.secrets import op10_secrets
from inkstrata.llm.simhash import op3_simhash
from inkstrata.llm.substring_dedup import op9_suffix_dedup
from inkstrata.llm.whitening import op11_whitening

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_html": op4_html,
    "op5_winnowing": op5_winnowing,
    "op6_embeddings": op6_embeddings,
    "op7_pii": op7_pii,
    "op8_katz": op8_katz,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_secrets": op10_secrets,
    "op11_whitening": op11_whitening,
    "op12_licenses": op12_licenses,
}

#: The contamination contract in plain SQL: every window of every item against every place of every document.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS k FROM s)),
place AS (SELECT r, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM d, (SELECT DISTINCT size FROM s) z WHERE len(w) >= size)),
hit AS (SELECT p.r, p.size, p.k, x.item_id FROM place p JOIN win x ON x.size = p.size AND x.g = p.g),
n AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + size - 1)) AS i FROM hit) GROUP BY r),
f AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN f USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op5_winnowing": OP5_SQL}
