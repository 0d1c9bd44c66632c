"""Conversation prefix trie: every distinct beginning of a conversation as a node, with what its subtree shares."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

#: Turns that a first-turn subtrie may have before it is divided by the next turn, and turns dealt to a task's tries.
MAX_TURNS, TASK_TURNS = 50_000, 50_000
#: Bytes of member ids that travel as one row, and groups to divide up to which their table is broadcast.
CHUNK, BROADCAST_GROUPS = 1 << 16, 4096
NO_IDS = hashlib.sha256(b"").hexdigest()

_NODE = "key string, up string, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, path``: a conversation's turns in order, each as the digest of role and text, a colon and the text's code points.

    Turns are ordered by ``turn`` (null first), then role and text; null roles and texts are
    empty. All rows are range-sorted, rows that are alike in everything dealt apart by position, and only the
    digests are gathered, so a conversation takes some 40 bytes a turn in its task. Rows without
    a conversation id are left out; repeated rows are turns of their own.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null").withColumn("at", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("at")]
    token = F.concat(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")), F.lit(":"), F.length("text").cast("string"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("at"), token.alias("token"))
    return placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("t")).select("conv_id", F.col("t.token").alias("path"))


def rebuilt(paths: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first h turns taken from the first conversation of its ``span`` ids (none if absent); h = crc32(id) mod ``most``."""
    base = F.col("conv_id") - F.col("conv_id") % span
    heads = paths.where(F.col("conv_id") % span == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    met = paths.withColumn("base", base).join(heads, "base", "left").withColumn("h", h)
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(head, F.slice("path", F.col("h") + 1, F.size("path"))).alias("path"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ``seq, conv_id, path`` to rows of one sequence's ids, joined up to ``CHUNK`` bytes."""
    seq, ids, size, path = None, [], 0, None

    def chunk() -> pa.RecordBatch:
        return pa.record_batch({"seq": [seq], "first": pa.array([int(ids[0])], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "ids": [",".join(ids)], "path": pa.array([path], pa.list_(pa.string()))})

    for batch in batches:
        column = batch.column("path")
        for i, (s, c) in enumerate(zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist())):
            if s != seq or size > CHUNK:
                if ids:
                    yield chunk()
                seq, ids, size, path = s, [], 0, column[i].as_py()
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield chunk()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by ``seq, first`` to a row for each sequence; the digest is fed chunk by chunk."""
    seq, row = None, None

    def done() -> pa.RecordBatch:
        path, n, least, digest = row
        return pa.record_batch({"path": pa.array([path], pa.list_(pa.string())), "n": pa.array([n], pa.int64()), "least": pa.array([least], pa.int64()), "ends": [digest.hexdigest()]})

    for batch in batches:
        for x in batch.to_pylist():
            if x["seq"] != seq:
                if row:
                    yield done()
                seq, row = x["seq"], [x["path"], 0, x["first"], hashlib.sha256()]
            if row[1]:
                row[3].update(b",")
            row[1] += x["n"]
            row[3].update(x["ids"].encode())
    if row:
        yield done()


def sequences(convs: DataFrame) -> DataFrame:
    """``path, n, least, ends`` of each distinct sequence: members, smallest member and the digest of all their ids.

    Copies of one conversation are folded to chunks of ids where they lie in the range-sorted
    table, so a sequence that a third of all conversations have reaches its task as some rows.
    """
    keyed = convs.select(F.md5(F.array_join("path", ",")).alias("seq"), "conv_id", "path")
    chunks = keyed.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_folded, "seq string, first long, n long, ids string, path array<string>")
    return chunks.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_digested, "path array<string>, n long, least long, ends string")


def _grown(rows: pd.DataFrame) -> pd.DataFrame:
    """Pointer tries of whole groups: nodes in the order of their making, so that their reverse is a postorder."""
    tops: dict[str, int] = {}
    kids: list[dict[str, int]] = []
    parent, depth, size, n, least, ends, of, up, outer = ([] for _ in range(9))

    def node(above: int, d: int, token: str, key: str | None, u: str | None, o: int | None) -> int:
        kids.append({})
        for column, value in ((parent, above), (depth, d), (size, int(token.rpartition(":")[2])), (n, 0), (least, None), (ends, NO_IDS), (of, key), (up, u), (outer, o)):
            column.append(value)
        return len(kids) - 1

    for key, u, cut, o, path, count, first, end in zip(rows["key"], rows["up"], rows["cut"], rows["outer"], rows["path"], rows["n"], rows["least"], rows["ends"]):
        at = tops.get(key)
        if at is None:
            at = tops[key] = node(-1, cut, path[cut - 1], key, u, o)
        n[at] += count
        least[at] = first if least[at] is None else min(least[at], first)
        for d in range(cut, len(path)):
            below = kids[at].get(path[d])
            if below is None:
                below = kids[at][path[d]] = node(at, d + 1, path[d], None, None, None)
            at = below
            n[at] += count
            least[at] = first if least[at] is None else min(least[at], first)
        ends[at] = end
    leaves, saved = [0 if k else 1 for k in kids], [(c - 1) * s for c, s in zip(n, size)]
    for i in range(len(kids) - 1, -1, -1):
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    above = pd.array([outer[i] if parent[i] < 0 else least[parent[i]] for i in range(len(kids))], "Int64")
    return pd.DataFrame({"key": of, "up": up, "top": [p < 0 for p in parent], "conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of divided groups: the one whose children were dealt out, and the unary run above it."""
    for rows in frames:
        out = []
        for r in rows.to_dict("records"):
            lens = [0] + [int(t.rpartition(":")[2]) for t in r["prefix"]]
            saved, children, ends, leaves = int(r["saved"]), int(r["children"]), r["ends"] or NO_IDS, max(1, int(r["leaves"]))
            for d in range(int(r["depth"]), int(r["cut"]) - 1, -1):
                saved += (int(r["n"]) - 1) * lens[d]
                top = d == r["cut"]
                above = (None if pd.isna(r["outer"]) else int(r["outer"])) if top else int(r["least"])
                out.append((r["key"], r["up"], top, int(r["least"]), d, above, int(r["n"]), children, leaves, saved, ends))
                children, ends = 1, NO_IDS
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])
        yield frame.astype({"parent_conv_id": "Int64"})


def _key(cut: Column) -> Column:
    return F.md5(F.array_join(F.slice("path", F.lit(1), cut), ","))


def trie(seqs: DataFrame, max_turns: int = MAX_TURNS, task_turns: int = TASK_TURNS) -> DataFrame:
    """The nodes of all prefixes of ``sequences``.

    Sequences are dealt by the digest of their first turn, and whole groups are hashed to as many
    tasks as their turns need; a task builds pointer tries and sums them in postorder. A group of more than
    ``max_turns`` turns is divided by its next turn, again and again; its common beginning is skipped at
    once. The nodes above a division are summed from what was dealt out, round by round upward, so
    no task holds more than ``max_turns`` turns of a group, one sequence excepted. No sequences give no nodes.
    """
    spark = seqs.sparkSession
    small_batches(spark)
    seqs = written(seqs)
    count, total, least = seqs.agg(F.count("*"), F.sum(F.size("path")), F.min("least")).first()
    if not count:
        return spark.createDataFrame([], _NODE).select(*_RESULT)
    root = spark.createDataFrame([("", None, 0, 0, None, [], least)], "key string, up string, cut int, depth int, outer long, prefix array<string>, least long")
    ended = seqs.where(F.size("path") == 0).select(F.lit("").alias("key"), F.col("n").alias("own"), "ends")
    splits = [(root, ended)]
    active = seqs.where(F.size("path") > 0).select("path", "n", "least", "ends", F.lit(1).alias("cut"), _key(F.lit(1)).alias("key"), F.lit("").alias("up"), F.lit(least).cast("long").alias("outer"))
    settled, tables = [], [seqs]
    while True:
        large = written(active.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.size("path")).alias("s")).where((F.col("c") > 1) & (F.col("s") > max_turns)).select("key"))
        tables.append(large)
        n_large = large.count()
        if not n_large:
            settled.append(active)
            break
        small = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large
        settled.append(active.join(small, "key", "left_anti"))
        within = active.join(small, "key", "left_semi")
        group = within.groupBy("key").agg(F.min("path").alias("lo"), F.max("path").alias("hi"), F.min("least").alias("least"), F.first("up").alias("up"), F.first("cut").alias("cut"), F.first("outer").alias("outer"))
        alike = F.array_position(F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False))), False) - 1
        split = written(group.withColumn("depth", alike.cast("int")).select("key", "up", "cut", "depth", "outer", F.slice("lo", F.lit(1), F.col("depth")).alias("prefix"), "least"))
        ask = split.select("key", "depth", F.col("least").alias("_least"))
        met = within.join(F.broadcast(ask) if n_large <= BROADCAST_GROUPS else ask, "key")
        ended = met.where(F.size("path") == F.col("depth")).select("key", F.col("n").alias("own"), "ends")
        onward = met.where(F.size("path") > F.col("depth")).withColumn("cut", F.col("depth") + 1)
        active = written(onward.select("path", "n", "least", "ends", "cut", _key(F.col("cut")).alias("key"), F.col("key").alias("up"), F.col("_least").alias("outer")))
        splits.append((split, ended))
        tables += [split, active]
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    buckets = max(1, -(-int(total or 0) // task_turns))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).repartition(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
    nodes = written(dealt.groupBy("bucket").applyInPandas(_grown, _NODE))
    parts, tops = [nodes], nodes.where("top")
    for split, ended in reversed(splits):
        below = tops.groupBy(F.col("up").alias("key")).agg(F.sum("n_convs").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("children"))
        met = split.join(below, "key", "left").join(ended, "key", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        met = met.select("key", "up", "cut", "depth", "outer", "prefix", "least", (F.coalesce("below", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n"), zero("leaves"), zero("saved"), zero("children"), "ends")
        run = written(met.mapInPandas(_runs, _NODE))
        parts.append(run)
        tops = tops.unionByName(run.where("top"))
    discard(*tables)
    out = parts[0].select(*_RESULT)
    for part in parts[1:]:
        out = out.unionByName(part.select(*_RESULT))
    return out


def prefix_trie(conversations: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """The prefix trie of the rebuilt conversations (``rebuilt``), a row for each node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs, n_children,
    n_leaves, saved_tokens`` (summed over the subtree: members beyond the first times the code points of
    the node's last text) and ``ends_sha256`` (of the ids of the members that end there). Null and empty roles
    and texts are alike, equal turn numbers are ordered by role and text, repeated rows are turns of
    their own, rows without a conversation id are left out, an empty table gives no rows and other columns are
    not read. A single conversation is held by one task, some 100 bytes a turn.
    """
    small_batches(conversations.sparkSession)
    return trie(sequences(rebuilt(paths(conversations))), max_turns)
