"""Text chunks, hashed vectors and retrieval (RAG-01 … RAG-06)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.severity import as_col
from ..plans.fence import once

# Chunk length, vector width, defaults of a query.
CHUNK_CHARS, DIM, TOP_K, MIN_SIMILARITY = 500, 384, 5, 0.5
# A token is a run of letters, digits and underscores.
TOKEN = r"[\p{L}\p{N}_]+"

# Starting knowledge: id, name, tactic, description, mitigations.
KNOWLEDGE = (
    ("T1566", "Phishing", "Initial Access", "Adversaries may send phishing messages to gain access to victim systems. Phishing involves social engineering techniques to trick users into clicking malicious links or opening attachments.",
     "User training, Email filtering, Multi-factor authentication"),
    ("T1110", "Brute Force", "Credential Access", "Adversaries may use brute force techniques to gain access to accounts when passwords are unknown or when password hashes are obtained.",
     "Account lockout policies, Multi-factor authentication, Password complexity requirements"),
    ("T1071", "Application Layer Protocol", "Command and Control", "Adversaries may communicate using application layer protocols to avoid detection. Common protocols include HTTP/HTTPS, DNS, and SMTP.",
     "Network intrusion detection, SSL/TLS inspection, DNS monitoring"),
    ("T1059", "Command and Scripting Interpreter", "Execution", "Adversaries may abuse command and script interpreters to execute commands, scripts, or binaries.",
     "Disable or remove unused interpreters, Code signing, Execution prevention"),
    ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltration", "Adversaries may steal data by exfiltrating it over a different protocol than the existing command and control channel.",
     "Network segmentation, Data loss prevention, Egress filtering"),
    ("T1486", "Data Encrypted for Impact", "Impact", "Adversaries may encrypt data on target systems to interrupt availability. This is commonly associated with ransomware.",
     "Data backup, Behavior-based detection, Application isolation"),
)
PLAYBOOKS = (
    ("Phishing Response", ("Identify and isolate affected systems", "Block malicious URLs and sender addresses", "Reset credentials for affected users",
                           "Scan for malware on affected systems", "Review email logs for other recipients", "Document incident and update filters")),
    ("Ransomware Response", ("Isolate affected systems immediately", "Identify ransomware variant", "Check for available decryption tools", "Assess backup availability",
                             "Do not pay ransom without legal consultation", "Restore from clean backups", "Investigate initial access vector")),
    ("Data Breach Response", ("Contain the breach immediately", "Assess scope of data exposure", "Preserve evidence for investigation", "Notify legal and compliance teams",
                              "Prepare breach notification if required", "Remediate vulnerabilities", "Implement additional monitoring")),
)

#: vectors in a packed block of queries, and of chunks
QUERY_BLOCK, CHUNK_BLOCK = 2048, 4096
#: paragraphs whose chunk starts are listed at a time
FOLD = 256


def chunk_starts(lengths: Column, size: int = CHUNK_CHARS) -> Column:
    """Places (from 0) of the paragraphs that begin a chunk, from the paragraphs' lengths alone.

    The fold keeps what is open (its length) and lists the starts of ``FOLD`` paragraphs at a time, so
    no list is copied at each paragraph.
    """
    many = F.ceil(F.size(lengths) / FOLD).cast("int")
    folds = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice(lengths, i * FOLD + 1, FOLD))
    state = lambda open_, at, starts, kind: F.struct(open_.alias("open"), at.alias("at"), starts.cast(kind).alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["at"] > 0) & (acc["open"] + n < size)
        return state(F.when(fits, acc["open"]).otherwise(0) + n + 2, acc["at"] + 1, F.when(fits, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["at"])), "array<int>")

    def block(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, state(acc["open"], acc["at"], F.array(), "array<int>"), step)
        return state(inner["open"], inner["at"], F.array_append(acc["starts"], inner["starts"]), "array<array<int>>")

    return F.aggregate(folds, state(F.lit(0), F.lit(0), F.array(), "array<array<int>>"), block, lambda acc: F.flatten(acc["starts"]))


def chunk_rows(docs: DataFrame, text: Column | str, size: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` with position and content of each chunk; each text is split once and each chunk cut once.

    Paragraphs are added while the chunk stays below ``size``; a long paragraph stays whole. A null or
    empty text has no chunks; a last chunk of white space alone is left out.
    """
    at = F.sequence(F.lit(0), F.size("_starts") - 1)
    split = once(docs.withColumn("_paragraphs", F.split(as_col(text), "\n\n")).filter(F.size("_paragraphs") > 0))
    begun = once(split.withColumn("_starts", chunk_starts(F.transform("_paragraphs", lambda p: F.length(p)), size)))
    start = lambda i: F.get("_starts", i)
    part = lambda i: F.slice("_paragraphs", start(i) + 1, F.coalesce(start(i + 1), F.size("_paragraphs")) - start(i))
    each = begun.select(*docs.columns, F.size("_starts").alias("_n"), F.posexplode(F.transform(at, lambda i: _strip(F.array_join(part(i), "\n\n")))).alias("position", "content"))
    return each.filter((F.col("position") < F.col("_n") - 1) | (F.col("content") != "")).drop("_n")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def short_id(c: Column | str) -> Column:
    return F.substring(F.md5(as_col(c).cast("binary")), 1, 16)


def token_slots(text: Column | str) -> Column:
    """Vector slot of each token: md5 as a number modulo the width.

    The width divides 2**32 with rest 256, and so do the higher powers, hence the short form.
    """
    tokens = F.regexp_extract_all(F.lower(as_col(text)), F.lit(TOKEN), F.lit(0))

    def slot(t: Column) -> Column:
        digest = F.md5(t.cast("binary"))
        word = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
        return ((word(0) % DIM + word(1) % DIM + word(2) % DIM) * 256 + word(3)) % DIM

    return F.transform(tokens, slot)


def embed(text: Column | str) -> Column:
    """Bag-of-words vector of unit length (all zero for a text without tokens).

    Tokens are hashed by built-in functions; an Arrow batch of slots becomes one count matrix.
    """
    return _unit_counts()(F.coalesce(token_slots(text), F.array().cast("array<bigint>")))


def _unit_counts():
    @F.arrow_udf("array<double>")
    def unit_counts(slots: pa.Array) -> pa.Array:
        n = len(slots)
        rows = np.repeat(np.arange(n), slots.value_lengths().to_numpy(zero_copy_only=False))
        counts = np.bincount(rows * DIM + slots.flatten().to_numpy(zero_copy_only=False), minlength=n * DIM).astype(np.float64).reshape(n, DIM)
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        counts /= np.where(norm > 0, norm, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * DIM, DIM, dtype=np.int32)), pa.array(counts.ravel()))

    return unit_counts


def make_chunks(docs: DataFrame, text: str, source: Column, source_type: Column, keep: tuple = (), size: int = CHUNK_CHARS, vectors: bool = True) -> DataFrame:
    """Documents → chunk rows with ids and vectors; one narrow pass over the whole texts."""
    named = docs.select(*keep, source.alias("source"), source_type.alias("source_type"), as_col(text).alias("_text"))
    rows = chunk_rows(named, "_text", size).drop("_text")
    out = rows.select(*keep, short_id("content").alias("chunk_id"), short_id("source").alias("document_id"), "position", "content", "source", "source_type")
    return out.withColumn("embedding", embed("content")) if vectors else out


def default_knowledge(spark: SparkSession) -> DataFrame:
    rows = [(f"MITRE ATT&CK Technique: {i} - {n}\nTactic: {t}\nDescription: {d}\nMitigations: {m}", f"mitre_attack_{i}", "mitre") for i, n, t, d, m in KNOWLEDGE]
    rows += [(f"Incident Response Playbook: {n}\nSteps:\n" + "\n".join(f"{i}. {s}" for i, s in enumerate(steps, 1)), "playbook_" + n.lower().replace(" ", "_"), "playbook") for n, steps in PLAYBOOKS]
    df = spark.createDataFrame(rows, "content string, source string, source_type string")
    return df.select(short_id("content").alias("chunk_id"), short_id("source").alias("document_id"), F.lit(0).alias("position"), "content", "source", "source_type", embed("content").alias("embedding"))


def save_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    chunks.write.mode(mode).partitionBy("source_type").parquet(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _blocks(df: DataFrame, key: str, column: str, rows: int | None) -> DataFrame:
    """Keys and vectors of each partition in packed blocks of ``rows`` (one block a partition if None): block, keys, vectors.

    Arrow batches are joined whole; a batch never becomes Python lists.
    """
    kind = df.schema[key].dataType.simpleString()

    def pack(batches):
        at, held, n = TaskContext.get().partitionId(), [], 0

        def block(table):
            keys = table.column("key").combine_chunks()
            vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            ends = pa.array([0, len(keys)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.ListArray.from_arrays(ends, keys), pa.array([vectors.tobytes()], pa.binary())], names=["block", "keys", "vectors"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while rows and n >= rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, rows))
                held, n = table.slice(rows).to_batches(), n - rows
        if n:
            yield block(pa.Table.from_batches(held))

    return df.select(F.col(key).alias("key"), F.col(column).alias("vector")).mapInArrow(pack, f"block int, keys array<{kind}>, vectors binary")


def top_k(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """k best chunks per query by inner product, exact.

    Query blocks and chunk blocks meet in an equi-join on the query block's number (and a second
    number that deals the chunk blocks of one query block to many tasks). A pair of blocks is one
    matrix product, of which k rows per query go on. Vectors never pass through the driver.
    """
    query_type, key_type = queries.schema[query_id].dataType.simpleString(), chunks.schema[key].dataType.simpleString()
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    ways = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    asked = _blocks(queries.select(F.col(query_id).alias("query_id"), column).repartition(n), "query_id", column, None).select(
        F.col("block").alias("q"), F.col("keys").alias("ids"), F.col("vectors").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("part"))
    held = _blocks(chunks, key, column, CHUNK_BLOCK).select(
        "keys", "vectors", F.pmod(F.xxhash64("block", "keys"), F.lit(ways)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q"))

    def nearest(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                keys, ids = batch.column("keys")[r].values, batch.column("ids")[r].values
                vectors, asked = (np.frombuffer(batch.column(c)[r].as_buffer()).reshape(n, -1) for c, n in (("vectors", len(keys)), ("asked", len(ids))))
                names = keys.to_numpy(zero_copy_only=False)
                # equal scores: the smaller key first; the cut keeps all that share the k-th score
                by_key = np.argsort(names, kind="stable")
                scores = np.round(asked @ vectors.T, 9)[:, by_key]
                if len(keys) > k:
                    scores[scores < np.partition(scores, -k, axis=1)[:, -k:][:, :1]] = -np.inf
                query, at = np.nonzero(scores > -np.inf)
                found = scores[query, at]
                order = np.lexsort((at, -found, query))
                query, at, found = query[order], at[order], found[order]
                first = np.flatnonzero(np.diff(query, prepend=-1))
                within = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[within])), keys.take(pa.array(by_key[at[within]])), pa.array(found[within])], names=["query_id", key, "score"])

    best = held.join(asked, ["q", "part"]).select("keys", "vectors", "ids", "asked").mapInArrow(nearest, f"query_id {query_type}, {key} {key_type}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, min_similarity: float = MIN_SIMILARITY, source_type: str | None = None, text: str = "query_text") -> DataFrame:
    """Results per query: the best 2k first, then the similarity floor, then the source filter, then k."""
    distinct = chunks.dropDuplicates(["chunk_id"])
    asked = queries.select("query_id", embed(text).alias("embedding"))
    found = top_k(asked, distinct, 2 * k).filter(F.col("score") >= min_similarity)
    rows = found.drop("rank").join(distinct.drop("embedding"), "chunk_id")
    if source_type is not None:
        rows = rows.filter(F.col("source_type") == source_type)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def contexts(results: DataFrame) -> DataFrame:
    """Context text per query; a query has at most k results."""
    part = F.concat(F.lit("[Source: "), F.col("source"), F.lit(", Score: "), F.format_string("%.2f", F.col("score")), F.lit("]\n"), F.col("content"))
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("_p")).select(
        "query_id", F.array_join(F.transform("_p", lambda x: x["p"]), "\n\n---\n\n").alias("context"))
