"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, lines, merkle, mil, minhash, packing, sharding, topk, toxicity, trie, urlfilter, vptree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL counterpart when there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 40


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law: bytes (the map is edited until no move or swap of slots evens the shards out further)."""
    rows = sharding.sharded(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


#: (host, path) to verdict
URL_RULES = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block"}

_FITS = "CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}' END"
OP2_SQL = (
    "WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), "
    "r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u), "
    "p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, "
    "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r), "
    # the rules from the longest to the shortest
    "j AS (SELECT *, coalesce(" + ", ".join(_FITS.format(h=h, p=p) for h, p in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))) + ") AS rule FROM p) "
    "SELECT page_id, host, path, rule, CASE " + " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for (h, p), v in URL_RULES.items()) + " ELSE 'allow' END AS verdict FROM j"
)


@query("op2_url_filter", OP2_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list blocks; an address on no rule passes."""
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _hundredth():
    return F.col("id") % 100 == 0


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor 1: exact."""
    return vptree.nearest(table(spark, sf_dir, "embeddings"), _hundredth(), 10, 1.0)


_VECTORS = (
    "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL "
    "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{more})"
)
OP7_SQL = (
    "WITH " + _VECTORS.format(more="") + ", w AS (SELECT vec_id, list_transform(e, lambda x: floor(1024 * x)) AS e FROM v), "
    "s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score "
    "FROM w q JOIN w c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) "
    "SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"
)


@query("op7_exact_top_k", OP7_SQL)
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), _hundredth(), 10)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train_model(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "text", "n_lines", "n_removed")


#: CRC-32 of an ASCII text, bit by bit
_BITS = "flatten(list_transform(string_split({c}, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))"
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(" + _BITS + ", lambda b: b::BIGINT)), "
    "lambda crc, bit: xor(xor(crc, bit) >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END)))"
)

MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _manifest_sql(levels: int = 12) -> str:
    """Levels written out; twelve hold 68 billion rows of a language."""
    field = "coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c=text if c == "text" else c) for c in MANIFEST_FIELDS) + ")"
    parts = [f"""d AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC.format(c='doc_id::VARCHAR')} % 3 = 0 THEN {leaf(low)} END AS changed FROM documents),
 p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
 a0 AS MATERIALIZED (SELECT tree, ix, n, leaf AS h FROM p), f0 AS MATERIALIZED (SELECT *, ix AS pos, n AS m, '' AS sib, coalesce(changed, leaf) AS f FROM p)"""]

    def climb(t: str, f: str, k: int) -> None:
        parts.append(f"""{t}s{k} AS MATERIALIZED (SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY tree, ix // 8 ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY tree, ix // 8 ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k}),
 {f}{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (CASE WHEN f.m > 1 THEN f.pos // 8 ELSE f.pos END AS pos, CASE WHEN f.m > 1 THEN (f.m + 7) // 8 ELSE f.m END AS m,
  CASE WHEN f.m > 1 THEN f.sib || s.l || s.r ELSE f.sib END AS sib, CASE WHEN f.m > 1 THEN sha256(s.l || f.f || s.r) ELSE f.f END AS f) FROM {f}{k} f JOIN {t}s{k} s ON f.tree = s.tree AND f.pos = s.ix),
 {t}{k + 1} AS MATERIALIZED (SELECT tree, ix // 8 AS ix, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY ix)) AS h FROM {t}{k} WHERE n > 1 GROUP BY tree, ix // 8, n UNION ALL SELECT * FROM {t}{k} WHERE n = 1)""")

    for k in range(levels):
        climb("a", "f", k)
    parts.append(f"b0 AS MATERIALIZED (SELECT 0 AS tree, tree AS ix, count(*) OVER () AS n, h FROM a{levels}), "
                 f"g0 AS MATERIALIZED (SELECT 0 AS tree, f.doc_id, f.leaf, s.h AS subroot, f.tree AS pos, s.n AS m, f.sib, f.f FROM f{levels} f JOIN b0 s ON f.tree = s.ix)")
    for k in range(levels):
        climb("b", "g", k)
    return ("WITH " + ",\n ".join(parts) + f"\n SELECT doc_id, leaf, subroot, t.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM g{levels}, (SELECT h FROM b{levels}) t")


@query("op11_merkle_manifest", _manifest_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering: A-Z of the text in lower case where 3 divides the checksum of the id."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = [lower if f == "text" else F.col(f) for f in MANIFEST_FIELDS]
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", MANIFEST_FIELDS, changed, third).withColumnRenamed("key", "doc_id")


@query("op12_quality_attention")
def op12_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mil.scored(docs, mil.train_model(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


OP13_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 o AS MATERIALIZED (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS pos FROM t),
 c AS MATERIALIZED (SELECT conv_id, max(pos) AS n, conv_id - conv_id % 100 AS base, {_CRC.format(c='conv_id::VARCHAR')} % 6 AS h FROM o GROUP BY conv_id),
 e AS MATERIALIZED (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base),
 r AS MATERIALIZED (SELECT e.conv_id, o.pos AS d, o.role, o.text FROM e JOIN o ON o.conv_id = e.base AND o.pos <= e.head
  UNION ALL SELECT e.conv_id, e.head + o.pos - e.h, o.role, o.text FROM e JOIN o ON o.conv_id = e.conv_id AND o.pos > e.h),
 p AS MATERIALIZED (SELECT conv_id, d, length(text) AS chars, list(sha256(strlen(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM c),
 q AS MATERIALIZED (SELECT conv_id, d, chars, sha256(path::VARCHAR) AS node, sha256(path[1:d - 1]::VARCHAR) AS up, max(d) OVER (PARTITION BY conv_id) = d AS ends FROM p),
 k AS MATERIALIZED (SELECT node, d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
  sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM q GROUP BY node, d),
 m AS MATERIALIZED (SELECT k.*, coalesce(x.kids, 0) AS kids FROM k LEFT JOIN (SELECT up, count(*) AS kids FROM k GROUP BY up) x ON x.up = k.node),
 s AS MATERIALIZED (SELECT q.node, sum((m.n - 1) * m.chars) AS saved, count_if(m.kids = 0) AS leaves FROM m JOIN q ON q.conv_id = m.conv_id AND q.d <= m.d GROUP BY q.node)
 SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
 FROM m JOIN s ON s.node = m.node LEFT JOIN m u ON u.node = m.up"""


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
