"""Spelling variants by a dictionary of trie-node pairs.

All words form two tries, one of the words and one of the words read backwards, and the nodes of
both are numbered. A word is then a list of pairs (node of a beginning, node of an ending): pairs
that leave out one letter and pairs that leave out none. Two words that share a pair without a letter
each differ in that letter; a pair without a letter that equals another word's whole pair is that
word with a letter more. The pairs are joined as integers and every neighbour is found exactly.

The nodes are numbered by Spark: words are range-sorted, each task numbers the trie of its words
(a word adds the nodes below what it shares with the word before), and the nodes on the path of a
task's first word take the numbers that earlier tasks gave to the same beginnings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafermill.llm.common import discard, slices, stored

#: Words that a task holds before it passes its counts on.
FLUSH = 1 << 18
ROOT = -1
WHOLE, SKIPPED, SKIPPED_AGAIN = 0, 1, 2


def _counted(least: int, erase: int):
    """Words of texts with their counts."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall

    def words(doc, text: str) -> Iterator[str]:
        start = crc32(f"{'' if doc is None else doc}:".encode())
        for run in runs(text.encode().lower().decode()):
            h = crc32(run.encode(), start)
            if erase and not h % erase:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            yield run

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                    held.update(words(doc, text or ""))
                    if len(held) >= FLUSH:
                        yield _counts(held)
                        held.clear()
        yield _counts(held)

    return count


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, erase: int = 31) -> DataFrame:
    """(``word``, ``n``): maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least ``least`` code
    points, A-Z lower-cased. Where ``erase`` divides the crc32 h of ``id:run``, the run has lost its code
    point h % length (0: none does). Null texts have no words, a null id is empty."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted(least, erase), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the trie of a task's sorted paths: for every path the nodes from its first letter on."""
    part, last, nodes, made = TaskContext.get().partitionId(), "", [], 0
    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            same = 0
            while same < min(len(last), len(path)) and last[same] == path[same]:
                same += 1
            new = len(path) - same
            nodes[same:] = range((part << 40) + made, (part << 40) + made + new)
            made, last = made + new, path
            out.append(np.array(nodes, np.int64))
        columns = [batch.column("path"), batch.column("n"), pa.array([part] * batch.num_rows, pa.int64()), pa.array(out, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "n", "part", "nodes"])


def trie_nodes(words: DataFrame) -> DataFrame:
    """(``path``, ``n``, ``nodes``) for distinct ``words(path, n)``: the number of the trie node behind each
    letter. Equal beginnings have equal numbers; the last nodes are ordered like the paths.

    What the driver sees is one first and one last path for each task."""
    ranged = words.repartitionByRange("path").sortWithinPartitions("path")
    held = stored(ranged.mapInArrow(_numbered, "path string, n bigint, part bigint, nodes array<bigint>"), "trie-nodes")
    ends = held.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.max_by("nodes", "path").alias("nodes"))
    shared, before, numbers = [], "", []
    for row in ends.orderBy("part").toLocalIterator():
        first, same = row["first"], 0
        while same < min(len(before), len(first)) and before[same] == first[same]:
            same += 1
        earlier = numbers[:same]
        if same:
            shared.append((row["part"], earlier))
        # A node of the last path that is on the path of the first one may be an earlier task's.
        own = [(row["part"] << 40) + k for k in range(same)]
        numbers = [earlier[k] if k < same and x == own[k] else x for k, x in enumerate(row["nodes"])]
        before = row["last"]
    known = words.sparkSession.createDataFrame(shared, "part bigint, earlier array<bigint>")
    base = F.shiftleft("part", 40)
    renamed = F.transform("nodes", lambda x, k: F.when((k < F.size("earlier")) & (x == base + k), F.get("earlier", k)).otherwise(x))
    nodes = F.when(F.col("earlier").isNull(), F.col("nodes")).otherwise(renamed)
    # One row a task, so its size is bounded by the number of tasks.
    return held.join(F.broadcast(known), "part", "left").select("path", "n", nodes.alias("nodes"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of nodes of every word, some words at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            before, behind, kind, n, word = [], [], [], [], []
            for path, count, there, back in zip(*(part.column(c).to_pylist() for c in ("path", "n", "there", "back"))):
                size = len(path)
                starts, ends = [ROOT, *there], [*reversed(back), ROOT]
                before += starts[:-1] + starts
                behind += ends[1:] + ends
                # Skipping any letter of a run of equal ones gives the same word: the first stands for it.
                kind += [SKIPPED_AGAIN if i and path[i] == path[i - 1] else SKIPPED for i in range(size)] + [WHOLE] * (size + 1)
                n += [count] * (2 * size + 1)
                word += [there[-1]] * (2 * size + 1)
            yield pa.record_batch(
                {"before": pa.array(before, pa.int64()), "behind": pa.array(behind, pa.int64()), "kind": pa.array(kind, pa.int32()), "n": pa.array(n, pa.int64()), "word": pa.array(word, pa.int64())}
            )


def near_words(words: DataFrame) -> DataFrame:
    """Words with at least one near word: ``id``, ``n_near`` and ``best`` (``m``: minus the count of the near word
    with the largest count, ``word``: its id; ties: the smallest word).

    ``words`` has ``path``, ``n``, ``there`` and ``back`` (nodes of both tries); a word's id is its last
    node in ``there``. Words that share a pair with a letter left out differ in that letter alone,
    so a pair has one member for each letter of the alphabet at most, and one whole word. The pairs
    of words themselves are never written out: each member takes the size of its group and the best
    of the others. Each neighbour is met at one pair only.
    """
    pairs = words.mapInArrow(_pairs, "before bigint, behind bigint, kind int, n bigint, word bigint")
    member = F.struct((-F.col("n")).alias("m"), "word", "kind")
    groups = pairs.groupBy("before", "behind").agg(F.sort_array(F.collect_list(member)).alias("all"), F.max("kind").alias("most")).where("size(all) > 1 AND most > 0")
    groups = groups.select(
        "all",
        F.filter("all", lambda x: x["kind"] != WHOLE).alias("skipped"),
        F.filter("all", lambda x: x["kind"] == SKIPPED).alias("longer"),
        F.get(F.filter("all", lambda x: x["kind"] == WHOLE), F.lit(0)).alias("whole"),
    )

    def found(x):
        other = F.when(F.get("skipped", F.lit(0))["word"] == x["word"], F.get("skipped", F.lit(1))).otherwise(F.get("skipped", F.lit(0)))
        shorter = F.when(x["kind"] == SKIPPED, F.col("whole"))
        n = F.when(x["kind"] == WHOLE, F.size("longer")).otherwise(F.size("skipped") - 1 + shorter.isNotNull().cast("int"))
        best = F.when(x["kind"] == WHOLE, F.get("longer", F.lit(0))).otherwise(F.array_min(F.array(other, shorter)))
        return F.struct(x["word"].alias("id"), n.cast("bigint").alias("n_near"), F.struct(best["m"].alias("m"), best["word"].alias("word")).alias("best"))

    each = groups.select(F.inline(F.transform("all", found))).where("n_near > 0")
    return each.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def group_variants(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """Name the form of every word: the most frequent word one letter away, if far more frequent.

    ``counts`` has distinct ``word`` and ``n``. Two words are near if they differ by one inserted,
    deleted or replaced code point. A word's form is the near word with the largest ``n`` (ties: the
    smallest in code-point order) if that is at least ``ratio`` times the word's own; else null.

    Returns ``word``, ``form``, ``root`` (the last word when forms are followed; the word itself if it has
    none), ``n``, ``n_near`` and ``form_n``, one row a word. Null or empty words and null counts take no
    part. An empty table gives an empty result; other columns are not read. Counts grow by
    ``ratio`` (more than 1) from form to form, so few rounds reach the root.
    """
    counts = stored(counts.select(F.col("word").alias("path"), F.col("n").cast("bigint").alias("n")).where("path <> '' AND n IS NOT NULL"), "spelling-counts")
    there = trie_nodes(counts).withColumnRenamed("nodes", "there")
    back = trie_nodes(counts.select(F.reverse("path").alias("path"), "n"))
    both = stored(there.join(back.select(F.reverse("path").alias("path"), F.col("nodes").alias("back")), "path"), "spelling-nodes")
    words, near = both.select("path", "n", F.element_at("there", -1).alias("id")), near_words(both)
    named = words.join(near, "id", "left").withColumn("form_n", F.when(-F.col("best.m") >= ratio * F.col("n"), -F.col("best.m")))
    named = named.select("path", "n", "id", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n", F.when(F.col("form_n").isNotNull(), F.col("best.word")).alias("form"))
    named = stored(named, "spelling-forms")
    discard(both)

    roots = stored(named.where("form IS NOT NULL").select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = stored(roots.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(roots)
        roots = further
        if not roots.where("moved").head(1):
            break
    name = named.select(F.col("id").alias("_id"), F.col("path").alias("_path"))
    out = named.join(roots.drop("moved"), "id", "left")
    out = out.join(name.select(F.col("_id").alias("form"), F.col("_path").alias("form_word")), "form", "left")
    out = out.join(name.select(F.col("_id").alias("root"), F.col("_path").alias("root_word")), "root", "left")
    return out.select(F.col("path").alias("word"), F.col("form_word").alias("form"), F.coalesce("root_word", "path").alias("root"), "n", "n_near", "form_n")
