"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of hashes of its distinct n-word shingles.  Two documents
link when ``den * |A & B| >= num * |A | B|``.  Whatever total order the shingles
have, two linked sets of sizes p and q share at least l of their first
``p - ceil(t p) + l`` and ``q - ceil(t q) + l`` shingles (t = num / den), for every
l.  A longer prefix costs more postings but asks for more shared ones.

1.  ``shingle_table``: one scan; size, 128-bit fingerprint of the set (equal sets
    are one *class* from here on) and the longest prefix in hash order.
2.  Thinning: a document with fewer than l shingles in its prefix that another row
    holds has no partner and goes.  No pair is built for this; the shingles travel
    packed (``lots``).
3.  The classes left are read again with their whole sets and real document
    frequencies, which travel packed too.  In rare-first order each gets the length l of least estimated
    cost: postings scanned plus candidates (postings / l) to verify; where some l
    leaves fewer than l shared shingles the class goes at no cost.
4.  Star round: in each posting list the members are tested only against one pivot,
    the class whose shingles are the most frequent ones (least mean of 1 / frequency),
    which is the centre of a group of near copies.  Linked ones become one component,
    and lists whose members are all of one component are closed.  The work is linear
    in the postings, however large a group.
5.  What can still link across components is bounded by the shingles a class holds
    alone (u): a member whose u and the least u of the other components break the bound
    leaves the list.  Long lists get further star rounds with other pivots.
6.  Members of the long lists that are still open are measured against their list's
    pivot P: x shingles of P that they lack and y shared ones that P lacks.  Two members
    differ in ``u + u' + |x - x'| + |y - y'|`` shingles at least, and in as many as the
    parities of their shingles in 1,024 cells differ (``odd``).  Only pairs of different
    components that both bounds let pass are formed, whatever lists they share.
7.  Short lists (``HEAVY`` rows at most) are joined list by list with at least min(l)
    shared shingles per pair.  Every pair is verified on whole sets.  Nothing is capped.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, drop, lean, release, row_words, save, shingles, utf8
from .components import connected_components
from .lots import frequencies, lot_ids, rows_with_shared

#: Prefixes may grow by this share of a set (and SLACK shingles) over the shortest.
GROWTH, SLACK = 0.05, 2
#: Cost of verifying a candidate, in postings scanned.
VERIFY = 25.0
STAR_ROUNDS = 4
#: Rows of a posting list from which on its members are measured against a pivot.
HEAVY = 32
#: Words of 64 bits of the parities of a set.
ODD = 16
#: Key tables of up to so many rows are broadcast (40 bytes a row); larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Sets of pivots of up to so many shingles in all are broadcast (8 bytes each).
BROADCAST_TOKENS = 2_000_000


def required(n, num: int, den: int):
    """Least overlap with any linked set: ceil(t n)."""
    return -((-num * n) // den)


def _features(n: int, num: int, den: int, growth: float):
    def run(it):
        import pyarrow as pa

        for batch in it:
            ids, texts, hashes = batches(batch, ["doc_id", "text", "t"])
            buf, offsets = utf8(texts)
            for i, j, h, at in row_words(buf, offsets):
                sets = shingles(h, at, n)
                sizes = [len(s) for s in sets]
                marks = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                long = [min(required(m, num, den), math.ceil(growth * m) + SLACK) for m in sizes]
                cut = [s[: m - required(m, num, den) + x].view(np.int64) for s, m, x in zip(sets, sizes, long)]
                ends = np.cumsum([0, *map(len, cut)])
                yield pa.record_batch(
                    [
                        ids.slice(i, j - i).cast(pa.int64()),
                        hashes.slice(i, j - i),
                        pa.array(sizes, pa.int64()),
                        pa.array(marks[:, 0]),
                        pa.array(marks[:, 1]),
                        pa.array(long, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cut) if cut else np.zeros(0, np.int64))),
                    ],
                    names=["doc_id", "t", "n", "h1", "h2", "longest", "prefix"],
                )
    return run


def shingle_table(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, t (hash of the text), n, h1, h2, longest, prefix, row: saved; ``row`` numbers the rows."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("t", F.xxhash64("text"))
    out = base.mapInArrow(lean(_features(n, num, den, GROWTH)), "doc_id long, t long, n long, h1 long, h2 long, longest int, prefix array<long>")
    return save(out.withColumn("row", F.monotonically_increasing_id()), "shingles")


def _small(df: DataFrame) -> DataFrame:
    """``df``, a saved table of narrow rows, marked for broadcast if its counted rows keep the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def odd(tokens: np.ndarray) -> np.ndarray:
    """How many of the tokens fall into each of 64 ODD cells, modulo 2: two sets differ in as many tokens at least as these bits differ."""
    bits = np.bincount((tokens % np.uint64(64 * ODD)).astype(np.int64), minlength=64 * ODD) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(n: int):
    """Whole sets of documents whose set is the one that the row names (h1, h2)."""

    def run(it):
        import pyarrow as pa

        lot = lot_ids()
        for batch in it:
            ids, texts, h1, h2, many = batches(batch, ["id", "text", "h1", "h2", "many"])
            marks = np.stack([np.asarray(h1), np.asarray(h2)], axis=1).astype(np.int64)
            buf, offsets = utf8(texts)
            for i, j, h, at in row_words(buf, offsets):
                sets = shingles(h, at, n)
                for k, tokens in enumerate(sets, i):
                    if hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() == marks[k].tobytes():
                        yield pa.record_batch(
                            [ids.slice(k, 1), pa.array([len(tokens)], pa.int64()), pa.array([lot(len(tokens))], pa.int64()), many.slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens.view(np.int64))), pa.ListArray.from_arrays(pa.array([0, ODD], pa.int32()), pa.array(odd(tokens)))],
                            names=["id", "n", "lot", "many", "tokens", "odd"],
                        )

    return run


def _whole_sets(docs: DataFrame, feats: DataFrame, keep: DataFrame, n: int) -> DataFrame:
    """id, n, lot, tokens, odd of the classes ``keep`` (h1, h2, id, doc_id), saved."""
    again = feats.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("k")).where("k > 1").select("h1", "h2", "doc_id", F.lit(True).alias("many"))
    key = keep.join(again, ["h1", "h2", "doc_id"], "left").select("doc_id", "id", "h1", "h2", F.coalesce("many", F.lit(False)).alias("many"))
    key = save(key.where("doc_id is not null"), "keys")
    sets = docs.join(_small(key), "doc_id").select("id", "text", "h1", "h2", "many")
    sets = save(sets.mapInArrow(lean(_sets(n)), "id long, n long, lot long, many boolean, tokens array<long>, odd array<long>"), "sets")
    if sets.where("many").isEmpty():
        return sets
    # rows that repeat id and text: one of them
    return save(sets.where("not many").unionByName(sets.where("many").dropDuplicates(["id"])), "sets")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of saved pairs (a, b): na, nb and the size i of the intersection.  Equi-joins on the sets that a pair names."""
    ends = F.array(*(F.struct(F.col(c).alias("id"), F.lit(c == "b").alias("pivot")) for c in ("a", "b")))
    named = save(pairs.select(F.inline(ends)).distinct(), "named")
    few = F.broadcast if named.count() <= BROADCAST_ROWS else lambda df: df
    left = sets.join(few(named.where("not pivot")), "id").select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.join(few(named.where("pivot")), "id").select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    right = F.broadcast(right) if (right.agg(F.sum("nb")).first()[0] or 0) <= BROADCAST_TOKENS else right
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("i"))


def _linked(num: int, den: int):
    return F.col("i") * den >= num * (F.col("na") + F.col("nb") - F.col("i"))


def _choose(num: int, den: int):
    """Of one class: its shingles that others hold and their frequencies -> the adaptive prefix, u, l, and the mean of 1 / frequency (in 2^-32)."""

    def run(n: int, tokens: np.ndarray, df: np.ndarray):
        u, base = n - len(tokens), n * (den - num) // den
        if u > base:  # too many shingles of its own for any partner
            return None
        order = np.lexsort((tokens, df))
        # the u unshared shingles stand first: the first base + l shingles hold k = base + l - u shared ones
        length = np.arange(1, len(tokens) + 1) + u - base
        longest = math.ceil(n * 2 * GROWTH) + 2 * SLACK
        cost = np.where((length >= 1) & (length <= longest), np.cumsum(df[order]) * (1 + VERIFY / np.maximum(length, 1)), np.inf)
        best = int(np.argmin(cost))
        return tokens[order[: best + 1]], u, int(length[best]), int((u + (1 / df).sum()) / n * 2**32)

    return run


def _open_lists(posts: DataFrame, comp: DataFrame) -> DataFrame:
    """Postings of lists that hold two components at least, with each row's component, the list's length k and its least (u, c) as m."""
    with_comp = posts.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    lists = with_comp.groupBy("token").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"), F.min(F.struct("u", "c")).alias("m"), F.count("*").alias("k")).where("c_lo <> c_hi")
    return with_comp.join(lists.select("token", "m", "k"), "token")


def _compatible(na, nb, num: int, den: int):
    return (na * den >= nb * num) & (nb * den >= na * num)


def _bound(ua, ub, na, nb, num: int, den: int):
    """Each of the two holds u shingles alone; the overlap is n - u at most."""
    return (ua + ub) * num <= F.least(na - ua, nb - ub) * (den - num)


def _rest(posts: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """Postings that may still link across components: the u of a row and the least u of other components keep the bound.

    As components only grow, what left the postings once need not be looked at again.
    """
    rows = _open_lists(posts, comp)
    other = rows.where("c <> m.c").groupBy("token").agg(F.min("u").alias("u2"))
    rows = rows.join(other, "token").withColumn("uo", F.when(F.col("c") == F.col("m.c"), F.col("u2")).otherwise(F.col("m.u")))
    rows = rows.where((F.col("u") + F.col("uo")) * num <= (F.col("n") - F.col("u")) * (den - num))
    return save(rows.select("token", "id", "n", "u", "l", "o", "c", "k"), "rest")


def _centres(rows: DataFrame, lot: int) -> DataFrame:
    """The pivot p of each list: first its centre, then members by lot."""
    order = F.xxhash64("id", F.lit(lot)) if lot else F.col("o")
    return rows.groupBy("token").agg(F.min(F.struct(order.alias("o"), "id", "n", "u", "c")).alias("p"))


def _star_pairs(rows: DataFrame, lot: int, num: int, den: int) -> DataFrame:
    """Per class, the pivot of another component that it shares most lists with, as (a, b): b is the pivot."""
    cand = rows.join(_centres(rows, lot), "token").where("c <> p.c")
    cand = cand.where(_compatible(F.col("n"), F.col("p.n"), num, den) & _bound(F.col("u"), F.col("p.u"), F.col("n"), F.col("p.n"), num, den))
    cand = cand.groupBy("id", F.col("p.id").alias("pivot")).agg(F.count("*").alias("shared"))
    return cand.groupBy(F.col("id").alias("a")).agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("b"))


def _grown(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after the links (a, b): only the components that they join are worked on."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    old = comp.join(ends, "id", "full").select("id", F.coalesce("component", "id").alias("component"))
    old = save(old, "members")
    of = lambda c: old.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("ca", "cb").distinct()
    new = connected_components(edges, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("root"))
    out = save(old.join(new, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "components")
    drop(old)
    return out


def _differ(a: str, b: str, num: int, den: int):
    """Whether two measured members may link: both bounds of their difference are within what a link allows."""
    at = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    (ua, ub), (xa, xb), (ya, yb), (na, nb), (oa, ob) = map(at, ("u", "x", "y", "n", "odd"))
    most = (na + nb) * (den - num)
    cells = F.bit_count(oa[0].bitwiseXOR(ob[0]))
    for k in range(1, ODD):
        cells = cells + F.bit_count(oa[k].bitwiseXOR(ob[k]))
    return ((ua + ub + F.abs(xa - xb) + F.abs(ya - yb)) * (den + num) <= most) & (cells * (den + num) <= most)


def jaccard_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) over the distinct sets ``sets`` (id, n, lot, tokens, odd) that have a partner."""
    posts = save(frequencies(sets, _choose(num, den)), "postings")
    spark = sets.sparkSession
    release(spark)
    comp = spark.createDataFrame([], "id long, component long")
    tried: DataFrame | None = None

    def measure(pairs: DataFrame) -> DataFrame:
        """Overlaps of pairs that were not measured yet; those that link join their components."""
        nonlocal tried, comp
        if tried is not None:
            known = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = save(pairs, "pairs")
        found = save(_overlaps(pairs, sets), "overlaps")
        links = found.where(_linked(num, den)).select("a", "b")
        if not links.isEmpty():
            comp = _grown(comp, links)
        tried = pairs if tried is None else tried.unionByName(pairs)
        release(spark)
        return found

    heavy, rows, before = F.col("k") > HEAVY, posts.withColumn("c", F.col("id")), math.inf
    for lot in range(STAR_ROUNDS):
        measure(_star_pairs(rows.where(heavy) if lot else rows, lot, num, den))
        rows = _rest(rows.select("token", "id", "n", "u", "l", "o"), comp, num, den)
        left = rows.where(heavy).count()
        # star rounds go on while long lists are left and a round leaves clearly fewer rows of them
        if not left or left > 0.8 * before:
            break
        before = left
    if left:
        members = rows.where(heavy)
        members = save(members.join(_centres(members, 0), "token").select(F.col("p.id").alias("p"), "id", "n", "u", "c").distinct(), "members")
        at = save(_overlaps(members.where("id <> p").select(F.col("id").alias("a"), F.col("p").alias("b")), sets), "overlaps")
        links = at.where(_linked(num, den)).select("a", "b")
        if not links.isEmpty():
            comp = _grown(comp, links)
        at = at.select(F.col("a").alias("id"), F.col("b").alias("p"), F.col("na").alias("n"), (F.col("nb") - F.col("i")).alias("x"), (F.col("na") - F.col("i")).alias("y"))
        at = at.join(members.select("p", "id", "u"), ["p", "id"]).withColumn("y", F.col("y") - F.col("u"))
        at = at.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        at = save(at.join(sets.select("id", "odd"), "id"), "measured")
        a, b = at.alias("a"), at.alias("b")
        pairs = a.join(b, (F.col("a.p") == F.col("b.p")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.c") != F.col("b.c")) & _differ("a", "b", num, den))
        measure(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct())
        drop(members, at)
    rows = _open_lists(rows.where(~heavy).drop("c", "k"), comp)
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.c") != F.col("b.c"))
                   & _compatible(F.col("a.n"), F.col("b.n"), num, den) & _bound(F.col("a.u"), F.col("b.u"), F.col("a.n"), F.col("b.n"), num, den))
    pairs = pairs.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("a.l", "b.l")).alias("l"))
    measure(pairs.where("shared >= l").select("a", "b"))
    drop(posts)
    return comp.select(F.col("id").alias("node"), "component")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable by links of Jaccard similarity
    ``num/den`` or more, the document's own included.  Words are runs outside
    ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.  Null or blank text: no shingles, linked with
    nothing.  Fewer words than ``n``: one shingle.  Rows that share a doc_id are judged
    one by one.  A row without doc_id gets the component of its equal texts, if one of
    them has an id, else null, and has no links of its own.  Other columns are not read.
    """
    out = _components(docs, n, num, den)
    return out.select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))


def _components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, t (hash of its text), n_shingles, root (of its component) and name (least doc_id there); no root without shingles."""
    feats = shingle_table(docs, n, num, den)
    # classes of equal sets; one row stands for each
    classes = feats.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("r"), F.max("n").alias("n"))
    classes = save(classes.select("h1", "h2", "n", "r.doc_id", F.col("r.row").alias("id")), "classes")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if num < den:
        # a smaller set links only with its equals
        least = -(-num // (den - num))
        left = rows_with_shared(feats.where(F.col("n") >= least))
        keep = save(classes.join(left.withColumnRenamed("row", "id"), "id", "left_semi").select("h1", "h2", "id", "doc_id"), "thinned")
        release(docs.sparkSession)
        sets = _whole_sets(base, feats, keep, n)
        release(docs.sparkSession)
        comp = jaccard_links(sets, num, den)
        names = classes.select("id", "doc_id").join(comp.withColumnRenamed("node", "id"), "id")
        names = names.join(names.groupBy("component").agg(F.min("doc_id").alias("name")), "component").select("id", "component", "name")
        named = save(classes.join(names, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("root"), F.coalesce("name", "doc_id").alias("name")), "named")
        drop(sets, keep)
    else:
        named = classes.select("h1", "h2", F.col("id").alias("root"), F.col("doc_id").alias("name"))
    return feats.select("doc_id", "t", F.col("n").alias("n_shingles"), "h1", "h2").join(named, ["h1", "h2"], "left").drop("h1", "h2")


def _same(key: DataFrame, doc_id: str, text: str):
    return F.col(doc_id).cast("long").eqNullSafe(key["key_id"]) & (F.xxhash64(F.col(text).cast("string")) == key["key_t"])


def near_distinct_documents(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: of each component one row, that of the smallest doc_id.

    Rows are judged one by one, also where they repeat an id; rows without doc_id come
    last in their component.  Of rows that repeat id and text one stays.  Rows without
    shingles all stay.
    """
    rows = save(_components(docs, n, num, den).where("root is not null"), "placed")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "t")).alias("w"), F.count("*").alias("k"))
    rows = rows.join(first.where("k > 1"), "root")
    stays = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t") == F.col("w.t"))
    key = lambda df: df.select(F.col("doc_id").alias("key_id"), F.col("t").alias("key_t"))
    gone = _small(save(key(rows.where(~stays)).distinct(), "gone"))
    many = save(key(rows.where(stays)).groupBy("key_id", "key_t").count().where("count > 1").drop("count"), "repeated")
    hidden = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    kept = hidden.join(gone, _same(gone, doc_id, text), "left_anti")
    if not many.isEmpty():
        one = kept.join(many, _same(many, doc_id, text), "left_semi").dropDuplicates([doc_id, text])
        kept = kept.join(many, _same(many, doc_id, text), "left_anti").unionByName(one)
    return kept.toDF(*docs.columns)
