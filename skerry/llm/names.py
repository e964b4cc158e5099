"""Linking the spellings of one person or organisation (problem 6).

Spellings are folded to tokens.  A symmetric-delete neighbourhood index on the family name
brings together names within one edit: every token is stored under
itself and under each string with one letter left out.  Full names meet where the first given name agrees
too, up to one edit or a nickname; names with initials meet the best name of each pattern of
initials, since all names of one pattern fit initials equally well, and where they have full given names
behind an initial also every name that one of these agrees with.  Organisations meet by the first letters of all
their words.  So a common family name makes no
large block, and no pair that aligns is left out.  Candidates are aligned token by token, by the cheapest assignment (Hungarian method) that
permits initials, abbreviations, nicknames and one edit.

Each folded name takes one parent, the likeliest name of higher rank (full before abbreviated, a
first name in wide use before a rare one, frequent before rare) that it agrees with, so two frequent names are never joined by a rare or abbreviated one that would fit both; components
of these links are the entities.  Initials take a full name, full names only full names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skerry.functions.arrow import map_lists
from skerry.llm.components import connected_components
from skerry.llm.editdist import distance
from skerry.llm.lookalikes import Rewriter, fit_rewriter, rewritten
from skerry.operators.multivalue import ORG_HEADS, PARTICLES, authors_array
from skerry.sources.tables import materialize, release

# Names and what they are called.
NICKNAMES = """
alexander alex sandy xander sasha; andrew andy drew; anthony tony; barbara babs barb barbie; benjamin ben benny;
catherine kate cathy katie cat kathy kit; christopher chris kit topher; daniel dan danny; deborah debbie deb debby; edward ed eddie ted ned teddy;
elizabeth liz beth betty eliza lizzie libby bess lisa; frederick fred freddie freddy; gerald gerry jerry; gregory greg; henry harry hank hal;
isabella bella izzy isa; james jim jamie jimmy; johanna jo hanna; joseph joe joey; judith judy jude; kenneth ken kenny; lawrence larry laurie;
margaret peggy maggie meg madge greta marge; matthew matt matty; michael mike mick mickey; nicholas nick nicky; patricia pat patty trish tricia; peter pete; philip phil pip; rebecca becky; richard dick rick rich ricky;
robert bob rob bobby robbie bert; ronald ron ronnie; samuel sam sammy; stephen steve stevie; susan sue susie suzy; theodore ted theo teddy;
thomas tom tommy; timothy tim timmy; victoria vicky vic tori; vincent vince vinny; william will bill billy willy liam; zachary zach zack; charles charlie chuck; david dave davy; dorothy dot dolly; eleanor ellie nell; francis frank; helen nell; jennifer jen jenny; jonathan jon; katherine kate kathy katie kit; martin marty; nathaniel nat nate; raymond ray; sarah sally; walter walt wally; virginia ginny
"""
_FORMAL: dict[str, set[str]] = {}
for _entry in NICKNAMES.split(";"):
    _full, *_short = _entry.split()
    for _x in _short:
        _FORMAL.setdefault(_x, set()).add(_full)

# Letters that have no decomposition.
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})
_NICK = re.compile(r'["“”„«»]+([^"“”„«»]*)["“”„«»]+')
_SMALL = frozenset("of for and the de la et und og".split())


def fold(text: str) -> str:
    """Case-folded text without accents."""
    t = unicodedata.normalize("NFKD", text.casefold().translate(_LETTERS))
    return "".join(c for c in t if not unicodedata.combining(c))


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text).replace("'", "").replace("’", ""))


def _is_initial(word: str) -> bool:
    letters = re.sub(r"[^\w]", "", word)
    return bool(letters) and (len(letters) == 1 or ("." in word and len(letters) <= 3 and word.upper() == word))


def _given(text: str) -> list[str]:
    """Given names and initials; a block of capitals is read as initials."""
    out = []
    for w in text.split():
        letters = re.sub(r"[^\w]", "", w)
        if letters.isupper() and (len(letters) <= 3 and ("." in w or "-" in w) or len(letters) == 1):
            out += list(fold(letters))
        else:
            out += _tokens(w)
    return out


def read_name(name: str) -> list[tuple[str, str]]:
    """Possible readings of a person's name as family (particles joined to it) and given names."""
    text = _NICK.sub(" ", name).strip(" ,")
    if "," in text:
        family, given = text.split(",", 1)
        words = given.split()
        k = len(words)
        while k and words[k - 1].casefold() in PARTICLES:
            k -= 1
        return [("".join(_tokens(" ".join(words[k:]) + " " + family)), " ".join(_given(" ".join(words[:k]))))]
    words = text.split()
    if len(words) < 2:
        return [("".join(_tokens(text)), "")]
    block = words[-1].replace("-", "").replace(".", "")
    capitals = all(w.isupper() for w in words)
    if block.isalpha() and block.isupper() and len(block) <= (3 if capitals else 4) and not _is_initial(words[0]) and not (capitals and words[-1].casefold() in PARTICLES):
        k = len(words) - 1
        while k > 1 and _is_initial(words[k - 1]):
            k -= 1
        initials = "".join(_tokens(" ".join(words[k:])))
        return [("".join(_tokens(" ".join(words[:k]))), " ".join(initials))]
    lead = 0
    while lead < len(words) - 1 and _is_initial(words[lead]):
        lead += 1
    if lead:
        return [("".join(_tokens(" ".join(words[lead:]))), " ".join(_given(" ".join(words[:lead]))))]
    inner = [i for i in range(1, len(words) - 1) if words[i].casefold() in PARTICLES or words[i].islower() and len(words[i]) <= 4]
    if words[0].casefold() in PARTICLES:
        k = 0
        while k < len(words) - 1 and words[k].casefold() in PARTICLES:
            k += 1
        return [("".join(_tokens(" ".join(words[: k + 1]))), " ".join(_given(" ".join(words[k + 1 :]))))]
    if inner:
        return [("".join(_tokens(" ".join(words[inner[0] :]))), " ".join(_given(" ".join(words[: inner[0]]))))]
    last = ("".join(_tokens(words[-1])), " ".join(_given(" ".join(words[:-1]))))
    if any(_is_initial(w) for w in words[1:-1]):
        return [last]
    return [last, ("".join(_tokens(words[0])), " ".join(_given(" ".join(words[1:]))))]


def is_organisation(name: str) -> bool:
    words = [w.strip("().,").casefold() for w in name.split()]
    return len(words) > 2 and (any(w in ORG_HEADS for w in words) or any(w in ("of", "for") for w in words[1:-1]))


def organisation_tokens(name: str) -> list[str]:
    return [t for t in _tokens(name.replace("&", " ")) if t not in _SMALL]


def deletes(token: str, least: int = 4) -> list[str]:
    """The token and every string with one of its letters left out.  Tokens of fewer than ``least`` letters agree
    only as they are: there one edit makes another name."""
    return list(dict.fromkeys([token, *(token[:i] + token[i + 1 :] for i in range(len(token)))])) if len(token) >= least else [token]


def given_keys(given: str) -> list[str]:
    """Keys of which two full given names share one if their first tokens agree: the token with its deletes,
    what it is a nickname of, and all tokens written together."""
    first, *rest = given.split(" ")
    return sorted({*deletes(first, 3), *_FORMAL.get(first, ()), *([f"{first}{''.join(rest)}"] if rest else [])})


def later_keys(given: str) -> list[str]:
    """Keys of which two names share one if a full given name behind the first of one agrees with such a one of the
    other, and their first letters are the same."""
    first, *rest = given.split(" ")
    return sorted({f"{first[:1]} {k}" for t in rest if len(t) > 1 for k in (*deletes(t, 3), *_FORMAL.get(t, ()))})


def organisation_keys(words: str) -> list[str]:
    """Keys of which two organisations share one if their words agree: the first letters of all words, since these stay
    in abbreviations and most edits; for up to three words with an edit in the first letter what such an
    edit leaves of them, beside the letters of the others."""
    ws = words.split()
    long = [i for i, w in enumerate(ws) if len(w) > 3]

    def key(left: tuple[str, ...], edited: tuple[int, ...]) -> str:
        return " ".join([str(len(ws)), *sorted(left), "".join(sorted(w[0] for i, w in enumerate(ws) if i not in edited))])

    out = {key((), ())}
    for edited in (x for n in (1, 2, 3) for x in combinations(long, n)):
        tails = [{ws[i], ws[i][1:], ws[i][0] + ws[i][2:]} for i in edited]
        # beside three or more letters one of the edited words is enough
        out |= {key(left, edited) for left in product(*tails)} if len(ws) < 6 else {key((t,), edited) for ts in tails for t in ts}
    return sorted(out)


def assign(costs: list[list[float]]) -> float:
    """Least total cost of giving each row a column of its own (rows no more than columns), by shortest
    augmenting paths."""
    n, m = len(costs), len(costs[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, before, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j]:
            used[j], row, gap, to = True, match[j], float("inf"), 0
            for k in range(1, m + 1):
                if not used[k]:
                    c = costs[row - 1][k - 1] - u[row] - v[k]
                    if c < least[k]:
                        least[k], before[k] = c, j
                    if least[k] < gap:
                        gap, to = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[match[k]] += gap
                    v[k] -= gap
                else:
                    least[k] -= gap
            j = to
        while j:
            match[j], j = match[before[j]], before[j]
    return sum(costs[match[k] - 1][k - 1] for k in range(1, m + 1) if match[k])


def token_cost(a: str, b: str) -> float:
    """Cost of reading two given names as one; over 1 they are different."""
    if a == b:
        return 0.0
    if a[:1] == b[:1] and (len(a) == 1 or len(b) == 1):
        return 0.2
    if _FORMAL.get(a, set()) & ({b} | _FORMAL.get(b, set())) or a in _FORMAL.get(b, ()):
        return 0.1
    if a[:1] == b[:1] and len(min(a, b, key=len)) > 2 and distance(a, b, 1) <= 1:
        return 0.5
    return 9.0


def align_given(a: str, b: str) -> float:
    """Cost of the best assignment of the fewer given names to the others, the first to the first.

    Names written together ("Anne Marie", "AnneMarie") agree; two unlike given names never do."""
    if a == b:
        return 0.0
    x, y = a.split(), b.split()
    if not x or not y:
        return 9.0
    if "".join(x) == "".join(y) and min(len(x[0]), len(y[0])) > 1:
        return 0.05
    if len(x) > len(y):
        x, y = y, x
    cost = token_cost(x[0], y[0])
    if cost > 1 or len(x) == 1:
        return cost + 0.01 * (len(y) - len(x))
    best = assign([[token_cost(p, q) for q in y[1:]] for p in x[1:]])
    return cost + best + 0.01 * (len(y) - len(x))


def _short_for(a: str, b: str) -> bool:
    """``a`` abbreviates ``b``: the same first letter, its letters in order in ``b``."""
    if len(a) >= len(b) or a[:1] != b[:1] or len(a) < 2:
        return False
    it = iter(b)
    return all(c in it for c in a)


def align_organisations(a: str, b: str) -> float:
    """Cost of the best one-to-one assignment of the words of two organisations, or 9."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return 9.0

    def cost(p: str, q: str) -> float:
        if p == q:
            return 0.0
        if _short_for(p, q) or _short_for(q, p):
            return 0.2
        return 0.5 if min(len(p), len(q)) > 3 and distance(p, q, 1) <= 1 else 9.0

    total, left = 0.0, list(y)
    open_x = []
    for p in x:
        if p in left:
            left.remove(p)
        else:
            open_x.append(p)
    if open_x:
        total = assign([[cost(p, q) for q in left] for p in open_x])
    return total if total < 2 else 9.0


def spellings(df: DataFrame, column: str, rewriter: Rewriter | None = None) -> DataFrame:
    """``name, n``: the distinct values of an author field, look-alike characters put right."""
    rewriter = rewriter or fit_rewriter(df, [column])
    items = df.select(F.explode(authors_array(F.col(column))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    plain = items.select(F.trim(rewritten(F.col("name"), rewriter)).alias("name"), "n").where("name <> ''")
    return plain.groupBy("name").agg(F.sum("n").alias("n"))


_READ = "name string, n bigint, org boolean, family string, given string, reading int, readings int"


def _readings(names: DataFrame) -> DataFrame:
    def make(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for name, n in zip(*batch, strict=True):
                if is_organisation(name):
                    out.append((name, n, True, "", " ".join(organisation_tokens(name)), 0, 1))
                else:
                    found = read_name(name)
                    out += [(name, n, False, f, g, i, len(found)) for i, (f, g) in enumerate(found)]
            yield out

    return map_lists(names.select("name", "n"), make, _READ)


def _slips(a: str, b: str) -> bool:
    """The first given names are both full and differ."""
    x, y = a.split(" ")[0], b.split(" ")[0]
    return x != y and len(x) > 1 and len(y) > 1


def _pair_costs(pairs: DataFrame) -> DataFrame:
    """``child, parent, cost, n`` of the candidate pairs that align."""

    def check(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for child, parent, org, fa, fb, ga, gb, ta, tb, n in zip(*batch, strict=True):
                if org:
                    c = align_organisations(ga, gb)
                else:
                    edits = distance(fa, fb, 1)
                    c = align_given(ga, gb) if edits <= 1 else 9.0
                    if 0.45 < c < 9 and _slips(ga, gb) and not (ta * 5 <= tb or ta == 1 < tb):
                        c = 9.0
                    c += 0.6 * edits
                if c < 2:
                    out.append((child, parent, float(c), n))
            yield out

    columns = ["child", "parent", "org", "fa", "fb", "ga", "gb", "ta", "tb", "n"]
    return map_lists(pairs.select(*columns), check, "child bigint, parent bigint, cost double, n bigint")


def entities(names: DataFrame) -> DataFrame:
    """``name, entity`` of every spelling of ``names`` (``name, n``).

    NULL and empty names give no row, repeated ones fall together; names without a given name
    (or initial) stay alone, as do organisations whose words do not all agree.
    """
    names = names.where("name is not null and trim(name) <> ''").groupBy("name").agg(F.sum("n").alias("n"))
    readings = materialize(_readings(names), "readings")
    read = readings
    sure = read.where("not org and readings = 1").groupBy("family").agg(F.sum("n").alias("support"))
    doubtful = read.where("readings > 1").join(sure, "family", "left")
    best = W.partitionBy("name").orderBy(F.coalesce("support", F.lit(0)).desc(), "reading")
    chosen = doubtful.withColumn("k", F.row_number().over(best)).where("k = 1").select(read.columns)
    read = read.where("readings = 1").unionByName(chosen)
    read = read.withColumn("node", F.xxhash64("org", "family", "given"))
    read = materialize(read.select("name", "n", "org", "family", "given", "node"), "names")
    release(readings)
    nodes = read.groupBy("node", "org", "family", "given").agg(F.sum("n").alias("n"))
    first = F.split("given", " ")[0]
    spread = nodes.where("not org").groupBy(first.alias("first")).agg(F.count_distinct("family").alias("spread"))
    nodes = nodes.withColumn("first", first).join(spread, "first", "left").withColumn("spread", F.coalesce("spread", F.lit(1)))
    # how widely a first name is used, in powers of five: a real one is wider than a slip of it
    nodes = nodes.withColumn("width", F.floor(F.log(5.0, F.col("spread"))))
    nodes = nodes.withColumn("full", F.col("org") | (F.length("first") > 1)).where("given <> ''")
    nodes = materialize(nodes, "name-nodes")
    a = [F.col("node").alias("child"), F.col("org"), F.col("family").alias("fa"), F.col("given").alias("ga"), F.col("spread").alias("ta"), F.struct("full", "width", "n", "node").alias("rank_a")]
    b = [F.col("node").alias("parent"), F.col("family").alias("fb"), F.col("given").alias("gb"), F.col("spread").alias("tb"), F.col("n"), F.struct("full", "width", "n", "node").alias("rank_b")]
    lower = (F.col("child") != F.col("parent")) & (F.col("rank_b") > F.col("rank_a"))
    # of one family and pattern the most frequent name stands for all
    best = W.partitionBy("family", _pattern(F.col("given"))).orderBy(F.desc("n"), F.desc("node"))
    heads = nodes.where("not org").withColumn("k", F.row_number().over(best)).where("k = 1")
    pairs = None
    for kind, (children, parents) in {"o": (nodes.where("org"), nodes.where("org")), "f": (nodes.where("full and not org"), nodes.where("full and not org")), "i": (nodes.where("not full"), heads), "m": (nodes.where("not full"), nodes.where("not org"))}.items():
        left, right = (t.select(*columns, F.explode(_index_keys(kind, F.col("family"), F.col("given"))).alias("key")) for t, columns in ((children, a), (parents, b)))
        # a small table has many keys: by its own size Spark would broadcast it
        met = left.join(right.hint("merge"), "key").where(lower).drop("key", "rank_a", "rank_b")
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = pairs.dropDuplicates(["child", "parent"])
    top = W.partitionBy("child").orderBy("cost", F.col("n").desc(), F.col("parent").desc())
    links = _pair_costs(pairs).withColumn("k", F.row_number().over(top)).where("k = 1").select(F.col("child").alias("a"), F.col("parent").alias("b"))
    groups = connected_components(links)
    release(nodes)
    return read.join(groups, "node", "left").select("name", F.coalesce("component", "node").alias("entity"))


def _index_keys(kind: str, family: Column, given: Column) -> Column:
    """Hashed keys by ``kind``: organisations by ``organisation_keys``, full names by family and first given name, names
    that may have initials by family and first letter (``m``: and a full given name behind it)."""

    @F.udf(T.ArrayType(T.StringType()), useArrow=True)
    def keys(f: str, g: str) -> list[str]:
        if kind == "o":
            return organisation_keys(g)
        of = given_keys(g) if kind == "f" else later_keys(g) if kind == "m" else [g[:1]]
        return [f"{k} {d}" for d in deletes(f) for k in of] if of else []

    return F.transform(keys(family, given), lambda k: F.xxhash64(k))


def _pattern(given: Column) -> Column:
    """The initials of a given name, full tokens marked: names of one pattern fit any initials equally well."""
    return F.array_join(F.transform(F.split(given, " "), lambda w: F.when(F.length(w) == 1, w).otherwise(F.concat(F.substring(w, 1, 1), F.lit("~")))), " ")


def spelling_pairs(named: DataFrame) -> DataFrame:
    """``name_a, name_b`` (``name_a`` < ``name_b``): all pairs of different spellings of one entity."""
    left = named.select("entity", F.col("name").alias("name_a"))
    right = named.select("entity", F.col("name").alias("name_b"))
    return left.join(right, "entity").where("name_a < name_b").select("name_a", "name_b")
