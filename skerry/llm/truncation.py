"""Text cut off by field limits and broken transfers (problem 1).

For every source the *discrete length hazard* is computed in five measures (characters, bytes
and words as delivered, characters and words as cleaned): the share of the texts at least L long that end
at exactly L.  Each hazard is tested against that of the neighbouring lengths, with the false
discovery rate held over all sources, lengths and measures.  A text at or just below a
significant length whose ending is incomplete was cut by a limit.

Texts cut at no particular length leave no mark in the hazards.  They are known by a cut mark
at the end, or by a classifier of endings fitted on sentences of a bounded sample of finished
texts, whole against cut at random places.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skerry.functions.arrow import map_lists
from skerry.llm.records import hash64
from skerry.sources.tables import materialize

#: Neighbouring lengths on each side that a hazard is tested against, by measure.
NEIGHBOURS = {"raw_chars": 40, "raw_bytes": 40, "chars": 40, "raw_words": 8, "words": 8}
#: How far below a limit a text may end that was cut back to a whole word or blank.
SLACK = {"raw_chars": 26, "raw_bytes": 28, "chars": 26, "raw_words": 0, "words": 0}
#: Texts that the classifier of endings is fitted on: about so many at most, picked by hash.
SAMPLE = 4_000
_BITS = 18

# What a cut leaves at the end, and what may follow a finished text.
MARK = re.compile(r"(?:\.{2,}|…|�|[\[(](?:\.{2,}|…|truncated|cut|continued|abridged|more)[\])]|\bread more|&hellip;)\s*$", re.I)
NOTE = re.compile(r"(?:\bkey ?words?\s*:[^\n]*|\bpalabras clave\s*:[^\n]*|\bmots[- ]cl[ée]s\s*:[^\n]*|\bschlagw[öo]rter\s*:[^\n]*|\bnøkkelord\s*:[^\n]*|(?:\(c\)|©|copyright)[^\n]{0,80}|\([^()\n]{1,60}\)|\[[^\[\]\n]{1,60}\]|https?://\S+|\bdoi:\s*\S+)\s*$", re.I)
CLOSED = re.compile(r"[.!?。]['\"”’»)\]]*\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def length_rows(df: DataFrame) -> DataFrame:
    """``source_file, measure, length`` of every distinct text of a source."""
    raw, text = F.coalesce("abstract_raw", "abstract"), F.col("abstract")
    measures = F.array(
        F.struct(F.lit("raw_chars").alias("measure"), F.char_length(raw).alias("length")),
        F.struct(F.lit("raw_bytes").alias("measure"), F.octet_length(raw).alias("length")),
        F.struct(F.lit("chars").alias("measure"), F.char_length(text).alias("length")),
        F.struct(F.lit("raw_words").alias("measure"), F.size(F.split(F.trim(raw), r"\s+")).alias("length")),
        F.struct(F.lit("words").alias("measure"), F.size(F.split(F.trim(text), r"\s+")).alias("length")),
    )
    distinct = df.where("abstract is not null and trim(abstract) <> ''").select("source_file", F.xxhash64(raw).alias("h"), measures.alias("m"))
    distinct = distinct.groupBy("source_file", "h").agg(F.first("m").alias("m"))
    return distinct.select("source_file", F.inline("m"))


def upper_tail(n: np.ndarray, risk: np.ndarray, h: np.ndarray) -> np.ndarray:
    """P(Binomial(risk, h) >= n), 1 where n is not above the mean: the incomplete beta function
    by its continued fraction, all tails at once."""
    out = np.ones(len(n))
    p = np.clip(h, 1e-12, 1 - 1e-12)
    rare = np.flatnonzero(n > risk * p)
    if not len(rare):
        return out
    k, r, p = n[rare].astype(float), risk[rare].astype(float), p[rare]
    a, b = k, r - k + 1
    lg = lambda x: np.array([math.lgamma(v) for v in x])
    front = lg(r + 1) - lg(a) - lg(b) + a * np.log(p) + b * np.log1p(-p) - np.log(a)
    tiny = 1e-300
    c, d = np.ones(len(a)), 1 - (a + b) * p / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    # above the mean the fraction settles after a number of steps of the order of the root of n
    for m in range(1, 200 + 5 * int(np.sqrt(a.max()))):
        for step in (m * (b - m) * p / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * p / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            f *= d * c
        if np.abs(d * c - 1).max() < 1e-12:
            break
    out[rare] = np.minimum(1.0, np.exp(np.minimum(0.0, front + np.log(np.maximum(f, tiny)))))
    return out


def below_rate(tested: DataFrame, rate: float, total: int) -> DataFrame:
    """The rows of ``tested`` (``p_value`` and a key) that Benjamini-Hochberg rejects at ``rate`` among ``total`` tests.

    Ranks are counted within ranges of the p-values and offset by the ranges below, so no task sorts all."""
    low = tested.where(F.col("p_value") <= rate).withColumn("range", F.floor(-4 * F.log2(F.greatest("p_value", F.lit(1e-300)))).cast("int"))
    counts = low.groupBy("range").agg(F.count("*").alias("k"))  # at most 4,000 ranges
    counts = counts.select("range", (F.sum("k").over(W.orderBy(F.desc("range"))) - F.col("k")).alias("before"))
    ranked = low.join(F.broadcast(counts), "range").withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("range").orderBy("p_value")))
    last = ranked.where(F.col("p_value") <= F.col("rank") * F.lit(rate / max(total, 1))).agg(F.max("p_value").alias("last"))
    return low.join(F.broadcast(last), F.col("p_value") <= F.col("last")).drop("range", "last")


def significant_lengths(lengths: DataFrame, rate: float = 0.001, least: int = 4, times: float = 4.0) -> DataFrame:
    """``source_file, measure, length, n, at_risk, hazard, p_value`` of the lengths at which texts end
    more often than at neighbouring ones, at a false discovery rate of ``rate``, with a hazard at
    least ``times`` theirs.

    The hazards are windows over counts by length, one partition for each source and measure;
    their size is the number of different lengths, whatever the number of texts.  Lengths of
    fewer than ``least`` texts are tested but never reported.
    """
    counts = lengths.groupBy("source_file", "measure", "length").agg(F.count("*").alias("n"))
    ordered = W.partitionBy("source_file", "measure").orderBy("length")
    risk = counts.withColumn("at_risk", F.sum("n").over(ordered.rowsBetween(0, W.unboundedFollowing)))
    parts = []
    for measure, k in NEIGHBOURS.items():
        near = ordered.rangeBetween(-k, k)
        part = risk.where(F.col("measure") == measure)
        # at-risk texts of lengths that none ends at: those of the next occurring length
        gap = F.col("length") - F.coalesce(F.lag("length").over(ordered), F.col("length") - 1)
        part = part.withColumn("exposed", F.col("at_risk") * F.least(gap, F.lit(2 * k)))
        part = part.withColumn("h0", (F.sum("n").over(near) - F.col("n") + 1) / (F.sum("exposed").over(near) - F.col("at_risk") + 1))
        parts.append(part)
    tested = parts[0]
    for p in parts[1:]:
        tested = tested.unionByName(p)

    def test(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for source, measure, length, n, at_risk, h0 in batches:
            tails = upper_tail(np.array(n), np.array(at_risk), np.array(h0, dtype=float)).tolist()
            yield list(zip(source, measure, length, n, at_risk, [k / r for k, r in zip(n, at_risk, strict=True)], h0, tails, strict=True))

    ddl = "source_file string, measure string, length int, n bigint, at_risk bigint, hazard double, h0 double, p_value double"
    # the windows are small and may have been put into one task; the tests are dealt out again
    dealt = tested.select("source_file", "measure", "length", "n", "at_risk", "h0").repartition("source_file", "measure", "length")
    tested = materialize(map_lists(dealt, test, ddl), "hazards")
    passed = below_rate(tested, rate, tested.count())
    return passed.where((F.col("n") >= least) & (F.col("hazard") >= times * F.col("h0"))).select(*[c for c in tested.columns if c != "h0"])


def hash_below(share: float) -> int:
    """The signed 64-bit value below which a share of all hashes lies; finer than one row at any number of rows."""
    return min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))


def _features(sentence: str) -> list[int]:
    """Hashed features of how a sentence ends and what it is made of."""
    tokens = _TOKEN.findall(sentence)
    low = [t.casefold() if not t.isdigit() else "0" for t in tokens]
    last = low[-1] if low else ""
    two, three = " ".join(low[-2:]), " ".join(low[-3:])
    start = " ".join(low[:2])
    keys = [f"1 {last}", f"2 {two}", f"3 {three}", f"s3 {last[-3:]}|", f"s4 {last[-4:]}|", f"s5 {last[-5:]}|", f"p {' '.join(low[-3:-1])}", f"q {' '.join(low[-4:-2])}", f"n {min(len(low), 24)}", f"l {len(last)}", f"o {start}", f"os {start} {last[-3:]}", f"c {tokens[-1][:1].isupper() if tokens else ''} {last[-3:]}", f"k {len(low) > 2 and low[-2] in ',;'}"]
    keys += [f"b {w}" for w in set(low[:-1])]
    keys += [f"t {w} {min(6, len(low) - 1 - i)}" for i, w in enumerate(low[-7:-1], max(0, len(low) - 7))]
    return [hash64(k) & ((1 << _BITS) - 1) for k in keys]


class Endings:
    """A logistic model of whether a text's last sentence is whole."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        """Log odds that the text ends with a whole sentence."""
        last = _SENTENCE.split(text.strip())[-1]
        return float(self.weights[_features(last)].sum() + self.bias)


def fit_endings(texts: list[str], rounds: int = 6, seed: int = 7) -> Endings:
    """Fit on the sentences of finished texts: whole, without their final mark, against cut at
    random characters.  The work is bounded by the number of texts given."""
    rng = np.random.default_rng(seed)
    rows, y = [], []
    for text in texts:
        for s in _SENTENCE.split(text.strip()):
            s = s.strip()
            if len(s) < 12 or s[-1] not in ".!?":
                continue
            whole = s[:-1].rstrip()
            rows.append(_features(whole))
            y.append(1.0)
            for at in rng.integers(4, max(5, len(whole) - 1), 1):
                rows.append(_features(whole[:at].rstrip()))
                y.append(0.0)
    weights, bias = np.zeros(1 << _BITS), 0.0
    if not rows:
        return Endings(weights, bias)
    label, grad2 = np.array(y), np.full(1 << _BITS, 1e-8)
    order, size = np.arange(len(rows)), 256
    flat = [np.array(r) for r in rows]
    for _ in range(rounds):
        rng.shuffle(order)
        for a in range(0, len(order), size):
            batch = order[a : a + size]
            cols = np.concatenate([flat[i] for i in batch])
            at = np.repeat(np.arange(len(batch)), [len(flat[i]) for i in batch])
            z = np.bincount(at, weights[cols], len(batch)) + bias
            err = 1 / (1 + np.exp(-z)) - label[batch]
            g = np.bincount(cols, err[at], 1 << _BITS)
            hit = np.unique(cols)
            grad2[hit] += g[hit] ** 2
            weights[hit] -= 0.3 * g[hit] / np.sqrt(grad2[hit]) + 1e-5 * weights[hit]
            bias -= 0.02 * float(err.mean())
    return Endings(weights, bias)


def truncated(df: DataFrame, rate: float = 0.001, sample: int = SAMPLE) -> DataFrame:
    """``record_sequence, source_file, reason`` of the records whose abstract was cut off.

    Needs ``record_sequence, source_file, abstract, abstract_raw``; other columns are ignored.
    ``reason`` is ``limit`` at a significant length of the source, ``mark`` with a cut mark, or
    ``ending``.  NULL or blank abstracts are no cases; repeated rows give a row each.
    """
    limits = materialize(significant_lengths(length_rows(df), rate), "limits")
    rows = limits.collect()  # at most a few lengths a source
    spots: dict[tuple[str, str], list[int]] = {}
    for r in rows:
        spots.setdefault((r["source_file"], r["measure"]), []).append(r["length"])
    text = F.col("abstract")
    finished = df.where(text.rlike(r"[^.!?][.!?]\s*$") & (F.char_length(text) < 20_000))
    # a share of the rows by hash, so that no task sends more than its part of the sample
    total = df.count()
    share = min(1.0, sample / max(1, total))
    picked = finished.where(F.xxhash64("record_sequence") <= hash_below(share)).select("abstract").collect()
    if not picked and total > 100 * sample and not finished.isEmpty():
        raise RuntimeError("the sample of finished abstracts is empty")
    model = fit_endings(sorted(r[0] for r in picked))  # without finished abstracts it takes every ending for whole

    def judge(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for seq, source, body, raw in zip(*batch, strict=True):
                body = body.rstrip()
                raw = body if raw is None else raw
                if MARK.search(body):
                    out.append((seq, source, "mark"))
                    continue
                if CLOSED.search(body) and not re.search(r"\b\d+\.$", body):
                    continue
                sizes = {"raw_chars": len(raw), "raw_bytes": len(raw.encode()), "chars": len(body), "raw_words": len(raw.split()), "words": len(body.split())}
                near = [spot - size for m, size in sizes.items() for spot in spots.get((source, m), ()) if 0 <= spot - size <= SLACK[m]]
                note = bool(NOTE.search(body))
                if near and (not note or min(near) == 0) and not CLOSED.search(body):
                    out.append((seq, source, "limit"))
                elif near and min(near) == 0:
                    out.append((seq, source, "limit"))
                elif not note and not CLOSED.search(body) and model.score(body) < 0:
                    out.append((seq, source, "ending"))
            yield out

    doubtful = df.select("record_sequence", "source_file", "abstract", "abstract_raw").where(text.isNotNull() & (F.trim(text) != "") & ~text.rlike(r"[^.\d][!?.]['\"”’»)\]]*\s*$"))
    return map_lists(doubtful, judge, "record_sequence int, source_file string, reason string")
