"""Filling fixed-capacity containers with texts (problem 7).

Documents are measured in tokens of a public tokenizer.  One longer than the capacity is split
into pieces of exactly the capacity and a rest; nothing else is split.  Items are dealt at random
to blocks of bounded size, and each block is packed on its own by Karmarkar-Karp multiway
differencing: the two partial partitions of the largest spread are merged, the fullest windows
of one on the emptiest of the other, until one partition into near-equal windows is left.  Where windows hold
only a few items some of them stay over capacity.  Then windows are settled one by one, each by at most one
exchange of items with the others that fills it, what is left is differenced again, and so on;
the last windows exchange items until none is over capacity.  The number of windows starts at the least that
could do and rises whenever a window stays over capacity.
"""

from __future__ import annotations

import heapq
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skerry.functions.arrow import map_lists
from skerry.sources.tables import materialize

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
#: Items of a block: what one task packs at a time.
BLOCK_ITEMS = 3_000


def token_counts(documents: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """``doc_id, n_tokens`` of every document; NULL and empty texts have none."""

    def count(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        t.no_truncation()
        for ids, texts in batches:
            sizes = []
            for a in range(0, len(texts), 64):
                sizes += [len(e.ids) for e in t.encode_batch_fast([x or "" for x in texts[a : a + 64]], add_special_tokens=False)]
            yield list(zip(ids, sizes, strict=True))

    return map_lists(documents.select("doc_id", "text"), count, "doc_id bigint, n_tokens int")


def differencing(sizes: list[int], k: int, apart: int = 0) -> list[list[int]]:
    """Partition into ``k`` windows by Karmarkar-Karp differencing: the indices in each window.

    A partial partition is its non-empty windows by falling sum; a binary heap gives the ones of
    the largest spread.  Windows are chains of indices, joined without copying.  The first ``apart`` items, of
    which no two may share a window, start as one partial partition, the others each as its own."""
    if not sizes:
        return [[] for _ in range(k)]
    link = [-1] * len(sizes)  # next index in the same window
    heap: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    if apart:  # windows: (-sum, first, last)
        first = sorted((-s, i, i) for i, s in enumerate(sizes[:apart]))
        heap.append((first[0][0] - (first[-1][0] if apart == k else 0), 0, first))
    for i, s in enumerate(sizes[apart:], apart):
        heapq.heappush(heap, (-(s if k > 1 else 0), i, [(-s, i, i)]))
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if over > 0:  # the emptiest windows of one take the emptiest of the other, fullest on emptiest
            tail_a, tail_b = a[len(a) - over :], b[len(b) - over :]
            del a[len(a) - over :]
            b = b[: len(b) - over]
            for (sa, fa, la), (sb, fb, lb) in zip(tail_a, reversed(tail_b), strict=True):
                link[la] = fb
                b.append((sa + sb, fa, lb))
        if len(b) <= 8:
            for w in b:
                insort(a, w)
        else:
            a += b
            a.sort()
        low = -a[-1][0] if len(a) == k else 0
        heapq.heappush(heap, (-(-a[0][0] - low), serial, a))
        serial += 1
    out = []
    for _, first, last in heap[0][2]:
        window, i = [first], first
        while i != last:
            i = link[i]
            window.append(i)
        out.append(window)
    return out + [[] for _ in range(k - len(out))]


def exchange(sizes: np.ndarray, windows: list[list[int]], capacity: int) -> bool:
    """Mend windows over ``capacity`` in place: the fullest hands an item to a window with room, or changes it
    for a smaller one there, as tightly as possible; whether none is over capacity in the end.

    Each step either settles a window over capacity or lessens what it is over, and takes none over capacity."""
    of = np.empty(len(sizes), dtype=np.int64)
    for w, items in enumerate(windows):
        of[items] = w
    room = capacity - np.bincount(of, weights=sizes, minlength=len(windows)).astype(np.int64)
    # items and, as items of size 0, the free places of the windows
    value = np.concatenate([sizes, np.zeros(len(windows), dtype=np.int64)])
    at = np.concatenate([of, np.arange(len(windows))])
    while (w := int(room.argmin())) >= 0 and room[w] < 0:
        need, space = -room[w], np.where(room > 0, room, -1)[at]
        best: tuple[int, int, int, int] | None = None
        for i in windows[w]:
            gain = sizes[i] - value
            fits = (gain > 0) & (gain <= space)
            full = np.flatnonzero(fits & (gain >= need))
            if len(full):  # settles the window; leave as little room as can be where the item goes
                j = int(full[(space - gain)[full].argmin()])
                key = (0, int(space[j] - gain[j]), i, j)
            elif fits.any():  # lessens it the most
                some = np.flatnonzero(fits)
                j = int(some[gain[some].argmax()])
                key = (1, -int(gain[j]), i, j)
            else:
                continue
            best = key if best is None or key < best else best
        if best is None:
            return False
        _, _, i, j = best
        v = int(at[j])
        gain = int(sizes[i] - value[j])
        windows[w].remove(i)
        windows[v].append(i)
        at[i] = v
        if j < len(sizes):
            windows[v].remove(j)
            windows[w].append(j)
            at[j] = w
        room[w] += gain
        room[v] -= gain
    return True


def settle(values: list[int], windows: list[list[int]], capacity: int, waste: int) -> tuple[list[list[int]], list[int]]:
    """Windows that one exchange with windows not yet settled fills up to ``waste``, and the items of all others.

    The windows of the largest items come first; each gives away one item or none and takes one or none,
    those that fill it best."""
    pool = sorted((v, i) for i, v in enumerate(values))  # items of windows not yet settled
    at = {i: w for w, items in enumerate(windows) for i in items}
    done = []
    for w in sorted(range(len(windows)), key=lambda w: -max((values[i] for i in windows[w]), default=0)):
        own = windows[w]
        for i in own:
            del pool[bisect_left(pool, (values[i], i))]
        room = capacity - sum(values[i] for i in own)
        best = (room, -1, -1) if room >= 0 else (capacity + 1, -1, -1)
        if best[0] > waste:
            for i in (-1, *own):
                space = room + (values[i] if i >= 0 else 0)
                if space < 0:
                    continue
                p = bisect_left(pool, (space + 1, -1)) - 1
                best = min(best, (space - pool[p][0], i, pool[p][1]) if p >= 0 else best, (space, i, -1))
        left, out, into = best
        if left > waste:
            for i in own:
                insort(pool, (values[i], i))
            continue
        v = at[into] if into >= 0 else -1
        if out >= 0:
            own.remove(out)
            insort(pool, (values[out], out))
            if v < 0:
                windows.append([])
                v = len(windows) - 1
            windows[v].append(out)
            at[out] = v
        if into >= 0:
            windows[at[into]].remove(into)
            del pool[bisect_left(pool, (values[into], into))]
            own.append(into)
        done.append(own)
    return done, [i for _, i in pool]


def pack_block(sizes: list[int], capacity: int, waste: float = 0.002, least: float = 0.01) -> list[list[int]]:
    """Windows of indices, none over ``capacity`` (no item may be).

    Differencing into the least number of windows that could do; where exchanges leave a window over capacity,
    windows that settle with a room of at most ``waste`` are kept and the other items differenced again.
    When a round settles less than a share ``least`` of its windows, the number of windows rises until
    exchanges leave none over capacity, at most to one an item.
    """
    rest, done, rising = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), [], 0
    while rest:
        values = [sizes[i] for i in rest]
        apart = sum(2 * v > capacity for v in values)
        k = max(-(-sum(values) // capacity), apart, 1) + rising
        windows = differencing(values, k, apart)
        trial = [list(w) for w in windows]
        if exchange(np.array(values, dtype=np.int64), trial, capacity):
            return done + [[rest[i] for i in w] for w in trial if w]
        if rising:
            rising += max(1, k // 100)
            continue
        full, left = settle(values, windows, capacity, int(waste * capacity))
        if len(full) < least * k:
            rising = 1
            continue
        done += [[rest[i] for i in w] for w in full]
        rest = [rest[i] for i in sorted(left)]
    return done


_PACKED = "capacity_id int, capacity_tokens int, container_id string, doc_id bigint, piece_no int, first_token int, piece_tokens int, container_tokens int"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["piece_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    capacity, cid, block = int(pdf.capacity_tokens[0]), int(pdf.capacity_id[0]), int(pdf.block[0])
    sizes = pdf.piece_tokens.tolist()
    number, fill = [""] * len(sizes), [0] * len(sizes)
    for c, window in enumerate(pack_block(sizes, capacity)):
        total = sum(sizes[i] for i in window)
        for i in window:
            number[i], fill[i] = f"{cid}-{block}-{c}", total
    return pdf.assign(container_id=number, container_tokens=fill)[[x.split()[0] for x in _PACKED.split(", ")]]


def packed(counts: DataFrame, capacities: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Every document or piece with its container and the container's fill, for each capacity.

    ``counts`` needs ``doc_id, n_tokens``, ``capacities`` (a small dimension) ``capacity_id,
    capacity_tokens``.  Documents without tokens take a place of size 0; a NULL count is one of 0,
    NULL ids are kept.  Capacities that are NULL or below 1 are left out, repeated ones are packed
    once; repeated documents are packed each time.  Empty tables give no rows.
    """
    caps = [(r[0], r[1]) for r in capacities.select("capacity_id", "capacity_tokens").distinct().collect() if r[1] and r[1] > 0]
    n = F.coalesce("n_tokens", F.lit(0))
    parts = []
    for cid, cap in caps:
        pieces = F.greatest(F.ceil(n / cap), F.lit(1)).cast("int")
        item = counts.select(F.lit(cid).alias("capacity_id"), F.lit(cap).alias("capacity_tokens"), "doc_id", n.alias("n"), F.posexplode(F.sequence(F.lit(1), pieces)).alias("p", "piece_no"))
        first = F.col("p") * cap
        parts.append(item.withColumn("first_token", first).withColumn("piece_tokens", F.least(F.col("n") - first, F.lit(cap))).drop("p", "n"))
    if not parts:
        return counts.sparkSession.createDataFrame([], _PACKED)
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    totals = dict(items.where(F.col("piece_tokens") < F.col("capacity_tokens")).groupBy("capacity_id").count().collect())
    blocks = F.create_map(*[F.lit(x) for cid, _ in caps for x in (cid, max(1, -(-totals.get(cid, 0) // block_items)))])
    # a full piece is a container of its own; the rest is dealt to blocks
    full = items.where(F.col("piece_tokens") == F.col("capacity_tokens"))
    full = full.withColumn("container_id", F.concat_ws("-", "capacity_id", F.lit("full"), "doc_id", "piece_no", F.row_number().over(W.partitionBy("capacity_id", "doc_id", "piece_no").orderBy("first_token")))).withColumn("container_tokens", F.col("piece_tokens"))
    dealt = items.where(F.col("piece_tokens") < F.col("capacity_tokens")).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no", "capacity_id"), blocks[F.col("capacity_id")]).cast("int"))
    open_ = dealt.groupBy("capacity_id", "block").applyInPandas(_pack, _PACKED)
    return open_.unionByName(full.select(*open_.columns))


def pack_documents(documents: DataFrame, capacities: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``packed`` over the token counts of ``doc_id, text``."""
    return packed(materialize(token_counts(documents, tokenizer), "token-counts"), capacities, block_items)
