"""Exact deduplication: sorted digest runs merged along a k-nomial tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import written

# What makes two texts the same row of a run: the digest, checked by the length and an independent second hash.
SAME = ["digest", "n_bytes", "second"]
# The letters that are lowered.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FAN_IN = 8


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def rounds_for(partitions: int, fan_in: int = FAN_IN) -> int:
    """Rounds of a tree that ends in at least ``partitions`` merged blocks."""
    rounds = 1
    while fan_in**rounds < partitions:
        rounds += 1
    return rounds


def digest_rows(docs: DataFrame, runs: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run, digest, n_bytes, second, prefix) of every row.

    ``run`` deals rows over ``runs`` by id, so that copies of one text lie in all runs alike; ``prefix`` is the
    start of the digest as a number and decides which block of the merged table owns it.
    """
    low = docs.select(F.col(doc_id).alias("doc_id"), lowered(F.col(text)).alias("low"))
    hashed = low.select(
        "doc_id", F.unhex(F.sha2("low", 256)).alias("digest"),
        F.octet_length("low").cast("bigint").alias("n_bytes"), F.xxhash64("low").alias("second"),
    )
    return hashed.withColumns({
        "run": F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"),
        "prefix": F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"),
    })


def _block(blocks: int) -> Column:
    """The share of the digest space, out of ``blocks`` equal ones, that owns a digest."""
    return F.shiftright(F.col("prefix") * F.lit(blocks).cast("bigint"), 32).cast("int")


def merge_runs(digests: DataFrame, rounds: int, fan_in: int = FAN_IN) -> DataFrame:
    """One row per text: (digest, n_bytes, second, prefix, keep_id, n_rows).

    Node ``run`` starts with its own run. In each round ``fan_in`` nodes exchange runs: every one of them takes over
    one share of the digests they own together and merges what the others hold of it. A node therefore keeps
    at most one row per text and source node, whatever the size of a group of copies, and after the last round every
    node owns one block of digests alone.
    """
    nodes = fan_in**rounds
    merged = [F.max("keep_id").alias("keep_id"), F.sum("n_rows").alias("n_rows")]
    table = digests.select("run", "prefix", *SAME, F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("n_rows"))
    table = table.groupBy("run", "prefix", *SAME).agg(*merged)
    for step in range(1, rounds + 1):
        left = fan_in ** (rounds - step)
        node = (_block(fan_in**step) * F.lit(left) + F.expr(f"run div {fan_in**step}")).cast("int")
        exchanged = table.withColumn("node", node).repartitionById(nodes, F.col("node")).sortWithinPartitions("node", *SAME)
        table = exchanged.groupBy("node", "prefix", *SAME).agg(F.first("run").alias("run"), *merged).drop("node")
    return table.drop("run")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Rows whose texts are equal after lowering A-Z form a group; its largest ``doc_id`` stays. A NULL text is an empty
    one. A NULL ``doc_id`` stays only in a group without any other; a row given twice with its id is flagged alike
    both times. Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rounds = rounds_for(int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in)
    digests = written(digest_rows(docs, fan_in**rounds, doc_id, text), "digests")
    groups = merge_runs(digests, rounds, fan_in)
    # Down again in two steps: a text has at most one row per run, and a run is one of many parts of its group.
    per_run = digests.select("run", *SAME).distinct().join(groups.select(*SAME, "keep_id", "n_rows"), SAME)
    return digests.join(per_run, ["run", *SAME]).select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the copies, all columns kept.

    A row that repeats both id and text is left once, whichever of its repeats. Ids that are NULL or name several rows
    cannot tell rows apart, so their rows are decided by id and digest; all others by id alone.
    """
    flags = written(exact_duplicates(docs, doc_id, text).select("doc_id", "kept", "text_sha256"), "kept")
    per_id = flags.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("any_kept"))
    odd = per_id.filter("n > 1 OR doc_id IS NULL")
    gone = per_id.filter("doc_id IS NOT NULL AND (n > 1 OR NOT any_kept)")
    plain = docs.filter(F.col(doc_id).isNotNull()).join(gone.select(F.col("doc_id").alias(doc_id)), doc_id, "left_anti")

    id_, sha = "__kept_id", "__kept_sha256"
    stay = flags.filter("kept").join(odd.select("doc_id"), flags["doc_id"].eqNullSafe(odd["doc_id"]), "left_semi")
    stay = written(stay.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias("__sha")).distinct(), "stay")
    if stay.isEmpty():
        return plain
    rows = docs.withColumn(sha, F.sha2(lowered(F.col(text)), 256))
    rows = rows.join(stay, rows[doc_id].eqNullSafe(stay[id_]) & (rows[sha] == stay["__sha"]), "left_semi")
    return plain.unionByName(rows.dropDuplicates([doc_id, sha]).drop(sha))
