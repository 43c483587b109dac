"""Language of texts that may mix languages: a path over the words with a price for switching.

Every word is scored for every language by its letter triples. The script of a word narrows the
languages first. The best path through the words of a text (Viterbi; each change of language
costs ``penalty``) labels spans; the language with the most letters is the text's.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wafermill.llm.common import slices

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words in one block of the path search. Blocks of all texts of a batch advance together.
BLOCK = 256
UNDECIDED = "und"

# Where the letters of a script begin (code point, script).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "asian"), (0x1C80, "cyrillic"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2DE0, "cyrillic"),
    (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"),
    (0xA000, "asian"), (0xA640, "cyrillic"), (0xA6A0, "asian"), (0xA720, "latin"), (0xA800, "asian"), (0xAB30, "latin"),
    (0xABC0, "asian"), (0xAC00, "hangul"), (0xD800, "asian"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "asian"),
    (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPTS]


def script_of(word: str) -> str:
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1]


@dataclass
class LanguageModel:
    """``triples``: letter triple -> row of ``scores`` (log probability by language); row 0 is for unknown ones."""

    languages: list[str]
    triples: dict[str, int]
    scores: np.ndarray
    scripts: dict[str, np.ndarray]
    penalty: float = 12.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """One row for each (distinct, lower-case) word."""
        get = self.triples.get
        rows, sizes = [], []
        for w in words:
            padded = f"^{w}$"
            rows += [get(padded[i : i + 3], 0) for i in range(len(w))]
            sizes.append(len(w))
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out = np.add.reduceat(self.scores[np.array(rows)], at, axis=0)
        every = np.ones(len(self.languages), bool)
        known = np.array([self.scripts.get(script_of(w), every) for w in words])
        return np.where(known, out, out.min(axis=1, keepdims=True) - 4 * self.penalty)


def train(docs: DataFrame, per_language: int = 1500, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", penalty: float = 12.0) -> LanguageModel:
    """Fit the scores on at most ``per_language`` labelled rows of each language, picked by digests of
    their ids. Rows without a label or text are left out. Counting is done
    by Spark; the counts of letter triples, bounded by the sample, come to the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("_h"), F.xxhash64(F.col(text_col)).alias("_t")
    )
    # About a third more rows than wanted pass by their digest; only these are ranked.
    sizes = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().collect()  # one row a language
    shares = [(r["lang"], 1.0 if r["count"] <= per_language else min(1.0, 1.3 * per_language / r["count"])) for r in sizes]
    few = docs.sparkSession.createDataFrame(shares, "lang string, _share double")
    likely = rows.join(F.broadcast(few), "lang").where(F.pmod("_h", F.lit(1 << 32)) < F.col("_share") * (1 << 32))
    ranked = likely.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_t")))
    words = ranked.where(F.col("_n") <= per_language).select(
        "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))).alias("word")
    )
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    triples = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(padded, i, F.lit(3)))
    table = counted.select("lang", "n", F.explode(triples).alias("triple")).groupBy("lang", "triple").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    names = sorted(table["triple"].unique())
    counts = np.zeros((len(names) + 1, len(languages)))
    place = {t: i + 1 for i, t in enumerate(names)}
    counts[table["triple"].map(place).to_numpy(int), table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = table["n"]
    scripts: dict[str, np.ndarray] = {}
    for t, i in place.items():
        if t[0] == "^":
            scripts[script_of(t[1])] = scripts.get(script_of(t[1]), np.zeros(len(languages))) + counts[i]
    starts = sum(scripts.values(), np.zeros(len(languages)))
    # A script counts for the languages that use it for one word in a hundred, or for all if none does.
    known = {s: n >= 0.01 * starts for s, n in scripts.items()}
    known = {s: k if k.any() else np.ones(len(languages), bool) for s, k in known.items()}
    smooth = counts + 0.5
    return LanguageModel(languages, place, np.log(smooth / smooth.sum(axis=0)) if languages else smooth, known, penalty)


def best_path(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word. ``scores`` holds the words of all texts, ``sizes`` their numbers."""
    k = scores.shape[1]
    ends = np.cumsum(sizes)
    per = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = (ends - sizes)[text] + nth * BLOCK
    length = np.minimum(BLOCK, ends[text] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    active = [int(np.searchsorted(-length, -t)) for t in range(BLOCK)]
    change = np.where(np.eye(k, dtype=bool), 0.0, -penalty)

    # What a block adds, for each label before it and at its end.
    through = np.repeat(change[None], len(begin), axis=0)
    for t in range(BLOCK):
        n = active[t]
        if not n:
            break
        if t:
            part = through[:n]
            np.maximum(part, part.max(axis=2, keepdims=True) - penalty, out=part)
        through[:n] += scores[begin[:n] + t][:, None, :]
    # From block to block, all texts together.
    so_far = np.zeros((len(sizes), k))
    before = np.zeros((len(begin), k), np.int64)
    for b in range(int(per.max(initial=0))):
        block = where[np.flatnonzero(nth == b)]
        own = np.flatnonzero(per > b)
        total = so_far[own][:, :, None] + through[block]
        before[block] = total.argmax(axis=1)
        so_far[own] = total.max(axis=1)
    last = np.zeros(len(begin), np.int64)
    entry = np.zeros(len(begin), np.int64)
    state = so_far.argmax(axis=1)
    for b in range(int(per.max(initial=0)) - 1, -1, -1):
        block = where[np.flatnonzero(nth == b)]
        own = np.flatnonzero(per > b)
        last[block] = state[own]
        state[own] = entry[block] = before[block, state[own]]
    # Inside the blocks, both ends known.
    value = change[entry]
    came = np.zeros((BLOCK, len(begin), k), np.int8)
    for t in range(BLOCK):
        n = active[t]
        if not n:
            break
        if t:
            part = value[:n]
            top = part.argmax(axis=1)
            jump = part[np.arange(n), top][:, None] - penalty
            switch = jump > part
            came[t, :n] = np.where(switch, top[:, None], np.arange(k))
            np.maximum(part, jump, out=part)
        value[:n] += scores[begin[:n] + t]
    label = np.zeros(len(scores), np.int64)
    state = last.copy()
    for t in range(BLOCK - 1, -1, -1):
        n = active[t]
        label[begin[:n] + t] = state[:n]
        if t:
            state[:n] = came[t, np.arange(n), state[:n]]
    return label


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the columns in ``keep``, ``lang_pred``, ``score`` and ``spans``.

    ``spans`` lists runs of words of one language (first and last word by number, language,
    letters). ``lang_pred`` has most of the letters (ties: the alphabetically first language),
    ``score`` is its share of them. A null text, one without a letter, or a model without
    languages gives ``und``, score 0 and no spans. Whole texts, row by row, no shuffle; other
    columns are not read. Repeated rows, null ids and empty tables pass as they are.
    """
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "_text"):
                found = [WORDS.findall((t or "").lower()) for t in part.column("_text").to_pylist()]
                sizes = np.array([len(f) if names else 0 for f in found], np.int64)
                place: dict[str, int] = {}
                at = np.fromiter((place.setdefault(w, len(place)) for f in found if names for w in f), np.int64, int(sizes.sum()))
                letters = np.array([len(w) for w in place], np.int64)
                ends = np.cumsum(sizes)
                preds, shares, spans = [], [], []
                if len(at):
                    label = best_path(model.word_scores(list(place))[at], sizes, model.penalty)
                    weight = letters[at]
                for e, n in zip(ends.tolist(), sizes.tolist(), strict=True):
                    if not n:
                        preds.append(UNDECIDED)
                        shares.append(0.0)
                        spans.append([])
                        continue
                    own, size = label[e - n : e], weight[e - n : e]
                    totals = np.bincount(own, weights=size, minlength=len(names))
                    best = int(totals.argmax())
                    preds.append(names[best])
                    shares.append(float(totals[best] / totals.sum()))
                    opens = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    closes = np.append(opens[1:], n)
                    sums = np.add.reduceat(size, opens)
                    spans.append(
                        [{"first": int(a), "last": int(b) - 1, "lang": names[own[a]], "letters": int(s)} for a, b, s in zip(opens, closes, sums, strict=True)]
                    )
                span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string()), ("letters", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in own_names), pa.array(preds, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, span)],
                    names=[*own_names, "lang_pred", "score", "spans"],
                )

    own_names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, own_names, strict=True)], F.col(text_col).alias("_text"))
    span_type = "array<struct<first:bigint,last:bigint,lang:string,letters:bigint>>"
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, own_names, strict=True))
    found = rows.mapInArrow(run, f"{schema}, lang_pred string, score double, spans {span_type}")
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, own_names, strict=True)], "lang_pred", "score", "spans")
