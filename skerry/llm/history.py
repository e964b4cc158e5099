"""Checking each new batch against everything already accepted (problem 5).

The sentences of an abstract are kept in a *segment index*: every sentence is cut into
``edits`` + 1 segments, stored under their length and place.  A new batch looks up selected
substrings of its own sentences, so every stored sentence within ``edits`` edits is found
without reading the stored texts; the records met this way are compared as wholes, and the
batch's segments are appended.

A ``History`` lives in a folder and is continued from there by any later session.  Batches that wait are accepted
together or one by one, with the same result.  Each table has a part for each acceptance and is only appended to;
one that failed half-way is done again and replaces its own parts.  Of the past an acceptance reads
fingerprints and index keys, which are numbers; the texts of past records are read once for all that wait
for verification, and only where there are candidates.

Records that are copies (problem 4), and records that agree in all but the DOI, share one entry: they are linked
to its first record, never to each other.  Two other records are compared if they share a key, have the same
series marks and enough title words in common; what the rule for a publication demands is asked before texts are
read.  A segment that more than ``hot`` records hold (boilerplate) is looked up together with a word of the title
that is rare in one of the two, and where more than ``CROWDED`` times as many share that as well together with a
form of an author's name.  Neither loses a pair that the rule would accept, so the result does not depend on ``hot``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skerry.functions.arrow import map_lists
from skerry.llm.components import connected_components
from skerry.llm.copies import canonical, count_buckets, radix_buckets, with_groups
from skerry.llm.editdist import distance, probes, segments
from skerry.llm.lookalikes import Rewriter, lookalike_classes, token_statistics
from skerry.llm.records import hash128, sentences, words
from skerry.operators.multivalue import split_authors
from skerry.sources.tables import drop_shuffles, materialize, release, shared_path

#: Sentences with fewer words are looked up only in records that have no longer ones.
SHORT = 5
#: Times ``hot`` that records may share a hot key and a title word before names are asked for as well.
CROWDED = 10
#: Rows a side may have to be broadcast; larger sides are shuffled.  A million record numbers take 140 MB of the driver for each
#: join, and joins of one query are built at once.  All other joins have a merge hint: a file of a few MB holds numbers enough.
BROADCAST_ROWS = 200_000

_SERIES = re.compile(r"\b(?:part|pt|parte|partie|teil|del|volume|vol)\b\.?\s*([ivxlc]+|\d+)\b|\b((?:1[89]|20)\d\d)\b", re.I)
_NOTE = re.compile(r"[\[(][^\])]*\b(?:version|v|rev|revision|press|first|online|paper|preprint)\b[^\])]*[\])]", re.I)
_CONTENT = "record_sequence int, batch_no int, fp binary, canon binary, form string, cls binary, series string, people string, body string"
#: Tables of a history and their columns.
TABLES = {
    "tokens": "token string, n bigint",
    "contents": _CONTENT,
    "entries": "fp binary, node int, canon_hash bigint, canon binary, form string, n bigint",
    "members": "record_sequence int, batch_no int, node int",
    "classes": "cls binary, record_sequence int, node int",
    "index": "key bigint, r int",
    "forms": "a int, b int",
    "candidates": "a int, b int",
    "accepted": "batch_no int",
    "links": "a int, b int",
}


def contents(df: DataFrame, rewriter: Rewriter) -> DataFrame:
    """One row per record with a title: canonical bytes and words, the hash of all that is compared (NULL without
    abstract), series marks, names, sentences."""

    def make(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for seq, no, title, authors, doi, abstract in zip(*batch, strict=True):
                title, authors = rewriter(title), rewriter(authors)
                ws = words(title)
                names = [" ".join(words(x)) for x in split_authors(authors)]
                canon, form, fp = canonical(ws, " ".join(names).split(), doi)
                series = " ".join(sorted({(a or b).casefold() for a, b in _SERIES.findall(_NOTE.sub(" ", title))}))
                body = "\n".join(sentences(abstract))
                cls = hash128("\0".join([" ".join(sorted(ws)), series, "\n".join(sorted(names)), body]).encode()) if body else None
                out.append((seq, no, fp, canon, form, cls, series, "\n".join(names), body))
            yield out

    columns = ["record_sequence", "batch_no", "title", "authors", "doi", "abstract"]
    return map_lists(df.select(*columns).where("title is not null and trim(title) <> '' and batch_no is not null"), make, _CONTENT)


def _indexed(body: str) -> list[str]:
    kept = list(dict.fromkeys(body.split("\n"))) if body else []
    return [s for s in kept if s.count(" ") >= SHORT - 1] or kept


def segment_keys(df: DataFrame, edits: int, ask: bool) -> DataFrame:
    """``key, r``: the keys to look up (``ask``) or to store for each record."""
    of = probes if ask else segments

    def make(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [(seq, [*{k for s in _indexed(body) for k in of(s, edits)}]) for seq, body in zip(*batch, strict=True)]

    return map_lists(df.select("record_sequence", "body"), make, "r int, keys array<bigint>").select(F.explode("keys").alias("key"), "r")


def title_words(df: DataFrame) -> DataFrame:
    """``record_sequence, ws, t, rare``: the distinct words of each title as hashes, the rarest first, and each of them.  Two titles
    that have 30 % of the shorter one's words in common share one that is ``rare`` in the shorter, and the first
    that they share is such a one."""
    each = df.select("record_sequence", F.explode(F.array_distinct(F.split(F.split_part("form", F.lit("|"), F.lit(1)), " "))).alias("t")).where("t <> ''").withColumn("t", F.xxhash64("t"))
    each = each.join(_few(materialize(each.groupBy("t").agg(F.count("*").alias("n")), "word-counts")), "t")
    lists = each.groupBy("record_sequence").agg(F.array_sort(F.collect_list(F.struct("n", "t")))["t"].alias("ws"))
    last_rare = F.size("ws") - F.ceil(F.lit(0.3) * F.size("ws"))
    return lists.select("record_sequence", "ws", F.posexplode("ws").alias("place", "t")).select("record_sequence", "ws", "t", (F.col("place") <= last_rare).alias("rare"))


def _long_words(people: str) -> list[list[str]]:
    """The words of each name by which it is compared."""
    return [[w for w in x.split() if len(w) > 3] or x.split() for x in people.split("\n")]


def name_keys(people: str, ask: bool) -> set[str]:
    """Keys of which two author lists share one (one asking, one stored) if ``_same_people`` may hold: the words
    with up to two letters left out, long endings, and marks by which lists without names meet all."""
    out = {"*"} if ask or not people else set()
    out |= {"+"} if not ask or not people else set()
    for w in {w for ws in _long_words(people) for w in ws} if people else ():
        out |= {"".join(c for i, c in enumerate(w) if i not in gone) for k in (0, 1, 2) for gone in combinations(range(len(w)), k)}
        out |= {f"-{w[i:]}" for i in range(len(w) - 5)}
    return out


def _near(a: str, b: str) -> bool:
    return a == b or (abs(len(a) - len(b)) <= 3 and (t := 1 if min(len(a), len(b)) < 5 else 2) and distance(a, b, t) <= t)


def _share(a: list[str], b: list[str], least: float = 0.0) -> float:
    """Share of the shorter list's words that the longer one has, up to small typos; 0 as soon as ``least`` is out of reach."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    left = list(b)
    hits, rest = 0, []
    for w in a:
        if w in left:
            left.remove(w)
            hits += 1
        else:
            rest.append(w)
    for i, w in enumerate(rest):
        if (hits + len(rest) - i) / len(a) < least:
            return 0.0
        for x in left:
            if len(w) > 2 and _near(w, x):
                left.remove(x)
                hits += 1
                break
    return hits / len(a)


def _same_people(a: str, b: str) -> bool:
    """Author lists that may be of one publication: half of the shorter list's names recur."""
    if not a or not b:
        return True
    names = _long_words(a)
    others = [w for x in b.split("\n") for w in x.split() if len(w) > 3] or b.split()
    need, hits, known = 0.5 * min(len(names), b.count("\n") + 1), 0, set(others)
    for i, n in enumerate(names):
        if hits >= need or hits + len(names) - i < need:  # settled either way
            break
        hits += not known.isdisjoint(n) or any(_near(w, o) or len(w) > 5 < len(o) and (w.endswith(o) or o.endswith(w)) for w in n for o in others)
    return hits >= need


def near_heads(form_a: str, people_a: str, form_b: str, people_b: str) -> bool:
    """Whether titles and names are near enough for one publication."""
    return _share(form_a.split("|")[0].split(), form_b.split("|")[0].split(), 0.6) >= 0.6 and _same_people(people_a, people_b)


def same_text(a: str, b: str, shared: float = 0.5) -> bool:
    """Whether a share of the shorter abstract's sentences recurs in the other up to small edits."""
    x, y = a.split("\n"), b.split("\n")
    if sum(map(len, x)) > sum(map(len, y)):
        x, y = y, x
    whole, got, open_y = sum(map(len, x)), 0, set(y)
    rest = []
    for s in x:
        if s in open_y:
            got += len(s)
        else:
            rest.append(s)
    if got < shared * whole:
        for s in rest:
            t = max(2, len(s) // 20)
            if any(abs(len(s) - len(o)) <= t and distance(s, o, t) <= t for o in open_y):
                got += len(s)
    return whole > 0 and got >= shared * whole


def same_publication(a: tuple[str, str, str, str], b: tuple[str, str, str, str], shared: float = 0.5) -> bool:
    """Whether two records (form, series, people, body) are of one publication: the same parts or
    years, half of the shorter abstract's sentences up to small edits, near titles and names."""
    if a[1] != b[1]:
        return False
    s, t = set(a[0].split("|")[0].split()), set(b[0].split("|")[0].split())
    if len(s & t) < 0.3 * min(len(s), len(t)):
        return False
    return near_heads(a[0], a[2], b[0], b[2]) and same_text(a[3], b[3], shared)


def _few(df: DataFrame) -> DataFrame:
    """``df``, broadcast if its rows are few enough, else joined by merging."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def _likely(pairs: DataFrame, titles: DataFrame) -> DataFrame:
    """The pairs with equal series marks and the title words in common that ``same_publication`` asks for."""
    titles = titles.select("record_sequence", "series", F.array_distinct(F.split(F.split_part("form", F.lit("|"), F.lit(1)), " ")).alias("t"))
    pairs = _few(pairs)
    for k in "ab":
        pairs = pairs.join(titles.withColumnsRenamed({"record_sequence": k, "series": f"{k}_series", "t": f"{k}_t"}).hint("merge"), k)
    common = F.size(F.array_intersect("a_t", "b_t")) >= F.lit(0.3) * F.least(F.size("a_t"), F.size("b_t"))
    return pairs.where((F.col("a_series") == F.col("b_series")) & common).select("a", "b")


def _fields_of(pairs: DataFrame, store: DataFrame, fields: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs with ``a_`` and ``b_`` fields, and the table of the fields that they are read from."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("record_sequence")).distinct(), f"{name}-ids")
    needed = materialize(store.select("record_sequence", *fields).join(_few(ids), "record_sequence", "left_semi"), name)
    release(ids)
    for k in "ab":
        pairs = pairs.join(needed.select(F.col("record_sequence").alias(k), *[F.col(f).alias(f"{k}_{f}") for f in fields]).hint("merge"), k)
    return pairs.select("a", "b", *[f"{k}_{f}" for k in "ab" for f in fields]), needed


def verified(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of one publication; ``store`` has the contents of all their records.

    Titles and names are compared first, so long texts go only where these are near."""

    def heads(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [r[:2] for r in zip(*batch, strict=True) if near_heads(*r[2:])]

    def bodies(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [r[:2] for r in zip(*batch, strict=True) if same_text(*r[2:])]

    likely = materialize(_likely(pairs, store), "likely-pairs")
    joined, read = _fields_of(likely, store, ["form", "people"], "candidate-heads")
    near = materialize(map_lists(joined, heads, "a int, b int"), "near-pairs")
    release(likely, read)
    drop_shuffles(store.sparkSession)
    joined, read = _fields_of(near, store, ["body"], "candidate-texts")
    found = materialize(map_lists(joined, bodies, "a int, b int"), "verified-pairs")
    release(near, read)
    drop_shuffles(store.sparkSession)
    return found


class History:
    """Everything accepted so far, as tables in a folder that all executors share.

    ``deliver`` takes records in, ``accept`` checks and indexes delivered batches, ``verify`` compares the
    candidates of the batches accepted since the last time, ``publications`` gives the result.  A new
    ``History`` of the same folder goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, edits: int = 1, hot: int = 50, capacity: int = 20_000) -> None:
        self.spark, self.edits, self.hot, self.capacity = spark, edits, hot, capacity
        self.path = path or shared_path(spark, "history")

    def parts(self, name: str) -> list[int]:
        """The finished parts of a table, by the last batch of each acceptance (contents: by batch)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.path}/{name}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        # the parts of contents are written together, so their mark is that of the table
        whole = [p for p in found if p.getName().startswith("batch=") and (name == "contents" or fs.exists(path(p, "_SUCCESS")))]
        return sorted(int(p.getName().split("=")[1]) for p in whole)

    def read(self, name: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{name}/batch={b}" for b in batches])

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return self.read(name, [batch])

    @property
    def accepted(self) -> list[int]:
        """The parts of finished acceptances."""
        return self.parts("accepted")

    def waiting(self) -> list[int]:
        """Delivered batches that are not accepted yet."""
        done = {r[0] for r in self.read("accepted", self.accepted).collect()}
        return [b for b in self.parts("contents") if b not in done]

    def deliver(self, df: DataFrame) -> list[int]:
        """Take in the records of one or more batches, in one pass; the batches that wait to be accepted."""
        fields = df.where("batch_no is not null").select("title", "authors")
        last = df.agg(F.max("batch_no")).first()[0]
        if last is not None:
            self._write(token_statistics(fields, ["title", "authors"]), "tokens", last)
            counts = self.read("tokens", self.parts("tokens")).groupBy("token").agg(F.sum("n").alias("n")).collect()
            rows = contents(df, Rewriter(lookalike_classes({r["token"]: r["n"] for r in counts})))
            rows.withColumn("batch", F.col("batch_no")).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/contents")
        return self.waiting()

    def accept(self, batches: list[int]) -> None:
        """Link the batches' copies, index their new texts and write their candidates among all accepted records."""
        batch = max(batches)
        before = [b for b in self.accepted if b != batch]
        rows = self.read("contents", batches)
        total = rows.count()
        # entries: records that are equal up to form; an entry's node is its first record
        seen = self.read("entries", before).select("fp", F.col("node").alias("known"))
        mine = rows.groupBy("fp").agg(F.min(F.struct("record_sequence", "canon", "form")).alias("m"), F.count("*").alias("n")).join(seen.hint("merge"), "fp", "left")
        mine = mine.select("fp", F.coalesce("known", "m.record_sequence").alias("node"), F.xxhash64("m.canon").alias("canon_hash"), "m.canon", "m.form", "n", F.col("known").isNull().alias("fresh"))
        mine = materialize(mine, "batch-entries")
        fresh = self._write(mine.where("fresh").drop("fresh"), "entries", batch)
        nodes = with_groups(rows.select("record_sequence", "batch_no", "fp", "cls"), mine, "fp", ["node"], total)
        nodes = materialize(nodes.select("record_sequence", "batch_no", "cls", "node"), "batch-nodes")
        self._write(nodes.drop("cls"), "members", batch)
        links = self._copy_links(fresh, before)
        # classes: texts that agree in all that is compared
        found = nodes.where("cls is not null").groupBy("cls").agg(F.min(F.struct("record_sequence", "node")).alias("m"), F.count("*").alias("n"))
        known = self.read("classes", before).select("cls", F.col("node").alias("known"))
        found = materialize(found.join(known.hint("merge"), "cls", "left").select("cls", "m.record_sequence", F.coalesce("known", "m.node").alias("head"), "n", F.col("known").isNull().alias("fresh")), "batch-classes")
        heads = self._write(found.where("fresh").select("cls", "record_sequence", F.col("head").alias("node")), "classes", batch)
        same = with_groups(nodes.where("cls is not null").select("cls", "node"), found, "cls", ["head"], total)
        links = links.unionByName(same.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))
        self._write(links.distinct(), "forms", batch)
        drop_shuffles(self.spark)
        # texts of the new classes go into the index
        new = rows.join(_few(heads.select("record_sequence")), "record_sequence", "left_semi")
        self._write(segment_keys(new, self.edits, ask=False), "index", batch)
        drop_shuffles(self.spark)
        self._write(self._candidates(new, [*before, batch]), "candidates", batch)
        drop_shuffles(self.spark)
        release(mine, nodes, found)
        self._write(self.spark.createDataFrame([(b,) for b in batches], TABLES["accepted"]), "accepted", batch)

    def _copy_links(self, fresh: DataFrame, before: list[int]) -> DataFrame:
        """Links (``a``, ``b``) of entries with equal canonical bytes and words."""
        stored = self.read("entries", before)
        if before:
            stored = stored.join(_few(fresh.select("canon_hash").distinct()), "canon_hash", "left_semi")
        both = fresh.unionByName(stored)
        several = both.groupBy("canon_hash").agg(F.count("*").alias("k")).where("k > 1")
        both = materialize(both.join(several.hint("merge"), "canon_hash", "left_semi").withColumn("first_sequence", F.col("node")), "like-entries")
        groups = count_buckets(radix_buckets(both.select("fp", "canon", "form", "n", "first_sequence"), self.capacity))
        return both.select("fp", "node").join(groups.select("fp", "first_sequence").hint("merge"), "fp").where("node <> first_sequence").select(F.col("node").alias("a"), F.col("first_sequence").alias("b"))

    def _candidates(self, new: DataFrame, batches: list[int]) -> DataFrame:
        """Pairs ``a`` < ``b`` of a new record and an indexed one (or two new ones) that share a key."""
        asked = segment_keys(new, self.edits, ask=True).withColumnRenamed("r", "p")
        met = self.read("index", batches[:-1]).withColumn("old", F.lit(True)).unionByName(self.read("index", batches[-1:]).withColumn("old", F.lit(False)))
        # of each segment there are probes in 2 * edits + 1 lengths, at no more than as many places
        few = self.read("index", batches[-1:]).count() * (2 * self.edits + 1) ** 2 <= BROADCAST_ROWS
        if few:  # a small batch picks the postings it asks for, and nothing stored is shuffled
            asked = F.broadcast(materialize(asked, "asked-keys"))
            met = materialize(met.join(F.broadcast(asked.select("key").distinct()), "key", "left_semi"), "met-keys")
        hot = materialize(met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > self.hot).select("key"), "hot-keys")
        some, least = not hot.isEmpty(), _few(hot)
        cold = met.join(least, "key", "left_anti") if some else met
        # a key that is not hot has a short list of holders; what is asked is shuffled once, to those and to the hot keys
        lists = cold.groupBy("key").agg(F.collect_list(F.struct("r", "old")).alias("holders"))
        if some:
            lists = lists.unionByName(hot.withColumn("holders", F.lit(None)), allowMissingColumns=True)
        hits = lists.join(asked if few else asked.hint("merge"), "key")
        if some:
            hits = materialize(hits, "key-hits")
            drop_shuffles(self.spark)
        pairs = hits.select("p", F.inline("holders"))
        if some:
            pairs = pairs.unionByName(self._hot_pairs(hits.where("holders is null").select("key", "p"), met.join(least, "key", "left_semi")))
        # two new records ask for each other, so one direction will do
        pairs = pairs.where("p > r or (old and p <> r)")
        return pairs.select(F.least("p", "r").alias("a"), F.greatest("p", "r").alias("b")).distinct()

    def _hot_pairs(self, asked: DataFrame, met: DataFrame) -> DataFrame:
        """Records that share a hot key, series marks and a title word that is rare in one of the two, and where
        these are many too a form of a name: all that ``same_publication`` would accept are among them."""
        ids = materialize(asked.select(F.col("p").alias("record_sequence")).unionByName(met.select(F.col("r").alias("record_sequence"))).distinct(), "hot-records")
        facts = materialize(self.read("contents", self.parts("contents")).select("record_sequence", "form", "series", "people").join(_few(ids), "record_sequence", "left_semi"), "hot-facts")
        titles = materialize(title_words(facts).join(facts.select("record_sequence", "series").hint("merge"), "record_sequence"), "hot-titles")
        on = ["k"]  # a hash of all that must agree: what meets by chance is compared again
        ask = asked.join(titles.withColumnsRenamed({"record_sequence": "p", "rare": "rare_p", "ws": "ws_p"}).hint("merge"), "p").select("p", F.xxhash64("key", "t", "series").alias("k"), "t", "rare_p", "ws_p")
        have = met.join(titles.withColumnsRenamed({"record_sequence": "r", "rare": "rare_r", "ws": "ws_r"}).hint("merge"), "r").select("r", "old", F.xxhash64("key", "t", "series").alias("k"), "rare_r", "ws_r")
        # a pair goes on from the first word it shares, if it shares enough
        common = F.array_intersect("ws_p", "ws_r")
        met_here = (F.col("rare_p") | F.col("rare_r")) & (F.get(common, F.lit(0)) == F.col("t")) & (F.size(common) >= F.lit(0.3) * F.least(F.size("ws_p"), F.size("ws_r")))
        drop_shuffles(self.spark)
        crowded = materialize(have.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > CROWDED * self.hot).select(*on), "crowded-words")
        if crowded.isEmpty():
            return have.join(ask.hint("merge"), on).where(met_here).select("p", "r", "old")
        crowd = _few(crowded)
        plain = have.join(crowd, on, "left_anti").join(ask.join(crowd, on, "left_anti").hint("merge"), on).where(met_here).select("p", "r", "old")

        def named(df: DataFrame, asking: bool) -> DataFrame:
            def make(rows: Iterator[list[list]]) -> Iterator[list[tuple]]:
                for seq, people in rows:
                    yield [(s, w) for s, x in zip(seq, people, strict=True) for w in name_keys(x, asking)]

            who = "p" if asking else "r"
            inside = df.join(crowd, on, "left_semi")
            keys = map_lists(facts.join(inside.select(F.col(who).alias("record_sequence")).distinct().hint("merge"), "record_sequence", "left_semi").select("record_sequence", "people"), make, f"{who} int, w string")
            return inside.join(keys.hint("merge"), who)

        close = named(have, False).join(named(ask, True).hint("merge"), [*on, "w"]).where(met_here).select("p", "r", "old")
        return plain.unionByName(close)

    def verify(self) -> None:
        """Compare the candidates of all batches accepted since the last time, reading the texts once."""
        done = self.parts("links")
        waiting = [b for b in self.accepted if b not in done]
        if waiting:
            found = verified(self.read("candidates", waiting), self.read("contents", self.parts("contents")))
            for b in waiting[:-1]:
                self._write(self.spark.createDataFrame([], TABLES["links"]), "links", b)
            self._write(found, "links", waiting[-1])
            release(found)

    def publications(self) -> DataFrame:
        """``record_sequence, batch_no, first_sequence, first_batch`` of every accepted record.

        Of the past only record numbers and links are read, no texts."""
        members = self.read("members", self.accepted)
        node = self.read("classes", self.accepted).select("record_sequence", "node")
        links = self.read("links", self.parts("links"))
        for k in "ab":
            links = links.join(node.withColumnsRenamed({"record_sequence": k, "node": f"n{k}"}).hint("merge"), k)
        links = links.select(F.col("na").alias("a"), F.col("nb").alias("b")).unionByName(self.read("forms", self.accepted))
        groups = connected_components(links)
        per = members.groupBy("node").agg(F.min("record_sequence").alias("s"), F.min("batch_no").alias("b"), F.count("*").alias("n"))
        per = materialize(per.join(groups.hint("merge"), "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component"), "nodes")
        first = per.groupBy("g").agg(F.min("s").alias("first_sequence"), F.min("b").alias("first_batch"), F.sum("n").alias("size")).where("size > 1")
        # single records are their own first; the others find theirs by their node
        known = materialize(per.join(first.hint("merge"), "g").select("node", "n", "first_sequence", "first_batch"), "first-records")
        out = with_groups(members, known, "node", ["first_sequence", "first_batch"], members.count())
        return out.select("record_sequence", "batch_no", F.coalesce("first_sequence", "record_sequence").alias("first_sequence"), F.coalesce("first_batch", "batch_no").alias("first_batch"))


def publications(df: DataFrame, path: str | None = None, edits: int = 1, hot: int = 50, capacity: int = 20_000) -> DataFrame:
    """``record_sequence, batch_no, first_sequence, first_batch`` of every record with title and batch:
    the smallest record and the earliest batch of its publication.

    Expects ``record_sequence, batch_no, title, authors, doi, abstract``; other columns are ignored.
    The batches are delivered and accepted together, each checked against those before it and against itself.  NULL
    authors agree with any, a NULL or empty abstract with none (such records are linked by being
    copies only); NULL titles and batches give no row.  Repeated rows fall into one publication.
    """
    history = History(df.sparkSession, path, edits, hot, capacity)
    if batches := history.deliver(df):
        history.accept(batches)
    history.verify()
    return history.publications()
