"""The queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_alignment
from .decontam import op8_decontam
from .html_text import op11_html
from .merkle import op12_merkle
from .packing import op1_packing
from .pii import op4_pii
from .quality_rank import op10_quality_rank
from .quality_rules import op5_quality_rules
from .secrets_scan import op7_secrets
from .sharding import op9_sharding
from .simhash import op2_simhash
from .token_files import op6_token_files
from .toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_secrets": op7_secrets,
    "op8_decontam": op8_decontam,
    "op9_sharding": op9_sharding,
    "op10_quality_rank": op10_quality_rank,
    "op11_html": op11_html,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP8_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words_sql('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[p:p + 12], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0) t),
cut AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT d.r, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) s WHERE len(d.w) >= s.n) t),
hit AS (SELECT cut.r, cut.p, cut.n, win.item FROM cut JOIN win ON win.g = cut.g AND win.n = cut.n),
cov AS (SELECT r, CAST(count(DISTINCT q) AS BIGINT) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) t GROUP BY r),
its AS (SELECT r, CAST(count(DISTINCT item) AS BIGINT) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
  sha256(coalesce(its.items, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AND 20 * coalesce(cov.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov ON cov.r = d.r LEFT JOIN its ON its.r = d.r"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# CRC-32 of a short ASCII text, bit by bit
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""


def _tree_sql(name: str, source: str) -> str:
    """Levels of the trees of ``source`` (tree, pos, h, n): (tree, lvl, pos, h, n)."""
    return f"""{name} AS (SELECT tree, CAST(0 AS BIGINT) AS lvl, pos, h, n FROM {source} UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 2)"""


def _way_sql(name: str, source: str, tree: str) -> str:
    """Way up of each row of ``source`` (r, tree, pos, cur, proof): cur folded with the siblings of ``tree``."""
    return f"""{name} AS (SELECT r, tree, CAST(0 AS BIGINT) AS lvl, pos, n, cur, proof FROM {source} UNION ALL
  SELECT w.r, w.tree, w.lvl + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN w.cur WHEN w.pos % 2 = 0 THEN w.cur || s.h ELSE s.h || w.cur END), w.proof || coalesce(s.h, '')
  FROM {name} w LEFT JOIN {tree} s ON s.tree IS NOT DISTINCT FROM w.tree AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1)"""


OP12_SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang AS tree, {_leaf('n_chars')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {_CRC.format('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS new FROM documents),
lv AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, new) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
src AS (SELECT tree, pos, leaf AS h, n FROM lv),
{_tree_sql('nodes', 'src')},
sub AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1),
tops AS (SELECT '' AS tree, tree AS lang, subroot AS h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM sub),
tsrc AS (SELECT tree, pos, h, n FROM tops),
{_tree_sql('up', 'tsrc')},
start AS (SELECT r, tree, pos, n, new AS cur, '' AS proof FROM lv),
{_way_sql('way', 'start', 'nodes')},
mid AS (SELECT w.r, t.tree, t.pos, t.n, w.cur, w.proof FROM way w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.tree WHERE w.n = 1),
{_way_sql('high', 'mid', 'up')},
top AS (SELECT h AS root FROM up WHERE n = 1)
SELECT d.doc_id, d.leaf, sub.subroot, top.root, sha256(high.proof) AS proof_sha256, high.cur AS folded_root, high.cur = top.root AS verified
FROM d JOIN sub ON sub.tree IS NOT DISTINCT FROM d.tree JOIN high ON high.r = d.r, top WHERE high.n = 1"""

# The others rest on tokenizers, XXH64, learned models or a greedy packing, which SQL cannot state;
# tests/llm compares them with brute force, round trips or held-out labels.
ORACLE: dict[str, str] = {"op8_decontam": OP8_SQL, "op12_merkle": OP12_SQL}
