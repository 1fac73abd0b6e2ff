"""Operator 9: near-duplicate grouping with SuperMinHash.

* Set of a document: distinct shingles of ``width`` words after lower-casing A-Z
  (with fewer words the whole sequence is one shingle; without words the set is
  empty and linked with nothing). Shingles are 64-bit hashes.
* Signature. Each element owns one random permutation of the ``slots`` positions,
  and at the j-th step of it offers ``j + u`` (u uniform) to the position reached;
  a slot keeps its minimum. Values of step j lie in [j, j + 1), so once every slot
  of a document holds a value below j + 1 later steps cannot change it and the
  document stops. All documents of a batch take each step together in numpy.
* Documents with equal sets form a class at once (similarity 1); a class is one node of
  the graph, whose text is that of its smallest id.
* Banding: ``bands`` x ``rows`` slots. At similarity 0.8 a pair misses all of
  32 x 4 with probability (1 - 0.8^4)^32 = 5e-8.
* Verification and union-find. In every bucket members are paired with a hub, the
  member with the most bucket mates overall (the text that a group of near copies
  stems from), never with each other: pairs grow with the rows of a bucket, not
  with their square. Pairs are checked on full sets, links joined by union-find.
  A bucket mate that its hub does not link can still be similar to another mate;
  such pairs are found through the edits they share against the hub, with an exact
  bound (``edit_entries``), and checked too, in rounds: a group that shares an edit is
  paired with a few of its members, then with more, each time only across components
  (``across``); a member's round is fixed at the start. No partner or candidate is capped.
* Texts behind candidate pairs are fetched by a bitmap of fixed size, hashed
  again, and joined to the pairs.

Rows: null ids take part under a null id (``kept`` false); rows repeating an id are
one document, which has the links of each of its texts (``n_shingles`` is the row's
own); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common as C

SLOTS, BANDS, ROWS = 128, 32, 4
WIDTH, PER_CENT = 5, 80
_U = np.uint64


# ---- sets and signatures -----------------------------------------------------------
def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): the sorted distinct shingle hashes of every text."""
    data, off = C.buffer(texts)
    s, e, first = C.word_spans(data, off)
    h = C.word_hashes(data, s, e)
    n = np.diff(first)
    with np.errstate(over="ignore"):
        roll = np.zeros(max(0, h.size - width + 1), np.uint64)
        for k in range(width):
            roll = (roll + h[k:h.size - width + 1 + k]) * _U(0xD6E8FEB86659FD93) if roll.size else roll
            roll = C.mix(roll + _U(k + 1))
    sets: list[np.ndarray] = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if n[i] >= width:
            sets.append(np.unique(roll[a:b - width + 1]))
        elif n[i]:
            whole = hashlib.blake2b(h[a:b].tobytes(), digest_size=8, salt=b"short").digest()
            sets.append(np.frombuffer(whole, np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    ends = np.cumsum([0, *[x.size for x in sets]])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), ends


def _step(x: np.ndarray, j: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """For element hashes: the position drawn from j..slots-1 and the value j + u."""
    with np.errstate(over="ignore"):
        r = C.mix(x + _U(j + 1) * C.GOLDEN)
    k = j + ((r & _U(0xFFFF)) * _U(slots - j) >> _U(16)).astype(np.int64)
    return k, (r >> _U(16)).astype(np.float64) / float(1 << 48) + j


def super_minhash(elements: np.ndarray, ends: np.ndarray, slots: int = SLOTS,
                  chunk: int = 1 << 16) -> np.ndarray:
    """Signatures (texts x slots) of the sets; rows of empty sets are infinite."""
    n = len(ends) - 1
    sig = np.full((n, slots), np.inf)
    doc = np.repeat(np.arange(n), np.diff(ends))
    if elements.size == 0:
        return sig
    flat = sig.reshape(-1)
    k, v = _step(elements, 0, slots)
    np.minimum.at(flat, doc * slots + k, v)
    open_docs = (sig >= 1).any(axis=1) & (np.diff(ends) > 0)
    # documents with free slots go on; their elements' permutations are carried in blocks of whole documents
    size = np.diff(ends)
    todo = np.flatnonzero(open_docs)
    at = 0
    while at < len(todo):
        end, total = at, 0
        while end < len(todo) and (total == 0 or total + size[todo[end]] <= chunk):
            total += size[todo[end]]
            end += 1
        _later_steps(elements, ends, todo[at:end], flat, slots)
        at = end
    return sig


def _later_steps(elements, ends, docs, flat, slots) -> None:
    x = np.concatenate([elements[ends[d]:ends[d + 1]] for d in docs])
    doc = np.repeat(docs, [ends[d + 1] - ends[d] for d in docs])
    perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (x.size, 1))
    row = np.arange(x.size)
    for j in range(slots):
        k, v = _step(x, j, slots)
        target = perm[row, k]
        perm[row, k] = perm[:, j]               # swap positions j and k
        perm[:, j] = target
        if j:
            np.minimum.at(flat, doc * slots + target.astype(np.int64), v)
        live = (flat.reshape(-1, slots) >= j + 1).any(axis=1)
        stay = live[doc]
        if not stay.any():
            return
        if stay.sum() < 0.7 * stay.size:
            x, doc, perm = x[stay], doc[stay], perm[stay]
            row = np.arange(x.size)


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(sig[:, :bands * rows]).view(np.uint64).reshape(len(sig), bands, rows)
    out = np.zeros(bits.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = C.mix(out * _U(31) + bits[:, :, r] + _U(r + 1))
    return out.view(np.int64)


_SIG_SCHEMA = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _signatures(width: int, slots: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch):
                elements, ends = shingle_sets(part.column(1), width)
                b = band_hashes(super_minhash(elements, ends, slots), bands, rows)
                size = np.diff(ends)
                keys = [_set_key(elements[ends[i]:ends[i + 1]]) for i in range(len(size))]
                offs = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offs), pa.array(b[size > 0].reshape(-1)))],
                    names=["doc_id", "n_shingles", "set_key", "bands"])
    return run


# ---- verification ------------------------------------------------------------------
def _set_key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch):
                elements, ends = shingle_sets(part.column(1), width)
                own = [elements[a:b] for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_set_key(x) for x in own], pa.binary()),
                     pa.array([x.tobytes() for x in own], pa.binary())],
                    names=["doc_id", "set_key", "elements"])
    return run


def _links(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.concatenate((p, q))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[i] = 100 * common >= per_cent * (both.size - common)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok))
    return run


def sets_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, elements) of every node in the (a, b) pairs, hashed again from the whole text of its smallest id."""
    some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = C.scratch(nodes.join(some, "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "set_key"), "near-some")
    ids = some.select("doc_id").distinct()
    texts = C.maybe_in(docs, "doc_id", C.bitmap(ids, "doc_id")).join(ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(C.released(_sets(width)), "doc_id long, set_key binary, elements binary")
    return C.scratch(sets.join(some, ["doc_id", "set_key"]).groupBy("node").agg(F.max("elements").alias("elements")), "near-sets")


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return (pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
                 .join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
                 .select("a", "b", "x", "y"))


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Those of the (a, b) pairs whose full sets reach the similarity."""
    return _both(pairs, sets).mapInArrow(C.released(_links(per_cent)), "a long, b long")


# ---- what a star cannot see: links between bucket mates that the hub does not link ---
def _edits(per_cent: int):
    """Rows (hub, doc, weight, size, edit): how a document's set differs from the hub's.

    ``edit`` is an element that the document lacks (complemented hash) or adds.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hub = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                own = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                lacks = np.setdiff1d(hub, own, assume_unique=True)
                adds = np.setdiff1d(own, hub, assume_unique=True)
                edit = np.concatenate((C.mix(lacks ^ ~_U(0)), C.mix(adds))).view(np.int64)
                n = edit.size
                # weight - hub_weight > 0 means: not similar enough to the hub
                weight = 100 * lacks.size + per_cent * adds.size
                over = weight - (100 - per_cent) * hub.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())),
                     pa.array(np.full(n, weight, np.int64)), pa.array(np.full(n, over, np.int64)),
                     pa.array(np.full(n, n, np.int64)), pa.array(edit)],
                    names=["hub", "doc", "weight", "over", "size", "edit"])
    return run


def edit_entries(family: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The edits under which a member of a hub's family can meet a similar one that the hub doesn't link:
    hub, edit, doc, weight, over, size, at (the edit's place among the member's, rarest first), is_x, is_y.

    Let x lack ``a`` and add ``b`` elements against the hub (H elements), and let
    o be the number of edits that x and y share. Then similarity(x, y) >= p % is
    the same as  (100 + p) o >= weight(x) + weight(y) - (100 - p) H  with
    weight = 100 a + p b, and x itself is linked to the hub just when
    over(x) = weight(x) - (100 - p) H <= 0. So for an x that the hub does not link, a
    partner y must share at least  need(y) = ceil((weight(y) + 1) / (100 + p))  of its
    own edits with x, about half of them, and x needs ceil(over(x) / (100 + p)) of its
    own. By the prefix principle two sets that share t elements meet within the rarest
    |set| - t + 1 of each: only those edits are entries (is_x, is_y by the role). The
    first edit that x and y share, at places i and j, leaves at most
    1 + min(|x| - i, |y| - j) shared ones, which must reach
    ceil((over(x) + weight(y)) / (100 + p)): ``_reach``. Nothing is lost.
    """
    per = 100 + per_cent
    rows = C.scratch(_both(family, sets).mapInArrow(
        C.released(_edits(per_cent)), "hub long, doc long, weight long, over long, size long, edit long"), "near-edits")
    seen = rows.groupBy("hub", "edit").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    # an edit that only one document has can meet no other; it still fills a place of the prefix
    rare = Window.partitionBy("hub", "doc").orderBy(F.col("seen"), F.col("edit"))
    need_y = F.ceil((F.col("weight") + 1) / F.lit(per))
    need_x = F.greatest(F.lit(1), F.ceil(F.col("over") / F.lit(per)))
    return (rows.join(seen, ["hub", "edit"], "left").withColumn("seen", F.coalesce("seen", F.lit(1)))
                .withColumn("at", F.row_number().over(rare)).where("seen > 1").drop("seen")
                .withColumn("is_x", (F.col("over") > 0) & (F.col("at") <= F.col("size") - need_x + 1))
                .withColumn("is_y", F.col("at") <= F.col("size") - need_y + 1).where("is_x or is_y"))


def _reach(per_cent: int):
    """Whether x and y, of which an edit is the first shared one, can share enough."""
    need = F.ceil((F.col("x.over") + F.col("weight")) / F.lit(100 + per_cent))
    return F.least(F.col("x.size") - F.col("x.at"), F.col("size") - F.col("at")) + 1 >= need


def across(entries: DataFrame, links: DataFrame, sets: DataFrame, per_cent: int, first: int = 16) -> DataFrame:
    """The links, with those between members of a family that lie in two components.

    Each x of a group (hub, edit) has its turn from the start, by a hash of its id: some ``first``
    have the first one, ``first`` times as many the next. A round pairs the x whose turn it is,
    so its pairs grow with the rows of a group and not with their square while links still join its
    components. Only new links write the groups again, with the rows that still have a partner:
    x with a later turn and y of another component than one of them. Done after the last turn.
    """
    turn, group = 0, _open(entries, components(links), first)
    while True:
        turn = group.where("is_x").agg(F.min(F.when(F.col("turn") >= turn, F.col("turn")))).first()[0]
        if turn is None:
            return links
        x = group.where(F.col("is_x") & (F.col("turn") == turn)).select(
            "hub", "edit", F.struct("over", "doc", "size", "at", "comp").alias("x"))
        pairs = (x.join(group.where("is_y"), ["hub", "edit"]).where(F.col("x.comp") != F.col("comp")).where(_reach(per_cent))
                  .select(F.least("x.doc", "doc").alias("a"), F.greatest("x.doc", "doc").alias("b")).distinct())
        new = C.scratch(verified(C.scratch(pairs, "near-pairs"), sets, per_cent), "near-links")
        turn += 1
        if not new.isEmpty():
            links = links.unionByName(new)
            group = _open(group.drop("comp").withColumn("is_x", F.col("is_x") & (F.col("turn") >= turn)), components(links), first)


def _open(entries: DataFrame, comp: DataFrame, first: int = 16) -> DataFrame:
    """The entries with their component ``comp``, of which a group's x and y lie in two: those that another one of
    the group can meet. Components only join, so what goes is not missed later. An x gets its ``turn`` the first time:
    its place among the x of its group by a hash (about), ``first`` for turn 0 and so many times more for each later one."""
    e = entries.join(comp, F.col("doc") == F.col("id"), "left").withColumn("comp", F.coalesce("component", "doc")).drop("id", "component")
    of = lambda role, f, name: f(F.when(F.col(role), F.col("comp"))).alias(name)
    two = e.groupBy("hub", "edit").agg(of("is_x", F.min, "x_lo"), of("is_x", F.max, "x_hi"), of("is_y", F.min, "y_lo"), of("is_y", F.max, "y_hi"),
                                       F.count_if("is_x").alias("n_x"))
    two = two.where("x_lo is not null and y_lo is not null and least(x_lo, y_lo) <> greatest(x_hi, y_hi)")
    e = e.join(two, ["hub", "edit"])
    apart = lambda lo, hi: (F.col(lo) != F.col("comp")) | (F.col(hi) != F.col("comp"))
    e = e.withColumn("is_x", F.col("is_x") & apart("y_lo", "y_hi")).withColumn("is_y", F.col("is_y") & apart("x_lo", "x_hi"))
    if "turn" not in e.columns:
        place = F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) / float(1 << 30) * F.col("n_x")
        e = e.withColumn("turn", F.floor(F.log(float(first), F.greatest(place, F.lit(1.0)))).cast("int"))
    return C.scratch(e.where("is_x or is_y").drop("x_lo", "x_hi", "y_lo", "y_hi", "n_x"), "near-groups")


# ---- union-find --------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over (a, b) links.

    Every task first joins its own links by union-find, which leaves a forest;
    then large-star and small-star steps until nothing changes. A hub with very
    many neighbours costs one minimum per task and a join that Spark can split.
    """
    forest = C.scratch(edges.select("a", "b").mapInArrow(_forest, "a long, b long"), "near-forest")
    while True:
        both = forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
                     .where("a <> b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = C.scratch(small, "near-forest")
        # done when every node points at one root and no root points anywhere
        roots = now.select(F.col("b").alias("a")).distinct()
        twice = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        if now.join(roots, "a", "left_semi").select("a").unionByName(twice).isEmpty():
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        forest = now


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                           pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 1 << 20:               # bounded memory: hand on what is joined so far
            yield out()
            parent.clear()
    yield out()


# ---- the operator ------------------------------------------------------------------
def near_duplicates(docs: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT, slots: int = SLOTS,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    C.prepared(spark)
    docs = C.pick(docs, doc_id="long", text="string")
    sigs = C.scratch(docs.mapInArrow(C.released(_signatures(width, slots, bands, rows)), _SIG_SCHEMA), "near-sigs")

    full = sigs.where("n_shingles > 0 and doc_id is not null")
    # a node per distinct set; its number is fixed by writing it
    nodes = C.scratch(full.groupBy("set_key").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep"))
                          .withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    nodes = nodes.drop("bands")
    sizes = keys.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = C.scratch(keys.join(sizes, ["band", "h"]), "near-buckets")
    mates = buckets.groupBy("node").agg(F.sum("n").alias("mates"))
    left = C.scratch(buckets.drop("n").join(mates, "node"), "near-mates")

    star = C.scratch(_hub_pairs(left), "near-star")
    sets = sets_of(star, nodes, docs, width)
    links = C.scratch(verified(star, sets, per_cent), "near-links")
    family = _open_families(star, components(links))
    links = across(C.scratch(edit_entries(family, sets, per_cent), "near-entries"), links, sets, per_cent)

    members = full.select("set_key", "doc_id").join(nodes, "set_key").select("doc_id", "node", "rep").distinct()
    members = C.scratch(members, "near-members")
    # the texts of an id that has several are one document
    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    same = members.join(several.select("doc_id", "a"), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    comp = C.scratch(components(links.unionByName(same)), "near-components")
    comp = comp.unionByName(comp.select(F.col("component").alias("id"), "component").distinct())
    lowest = (comp.join(nodes, F.col("id") == F.col("node")).groupBy("component").agg(F.min("rep").alias("low")))
    lowest = comp.join(lowest, "component").select(F.col("id").alias("node"), "low")
    moved = (members.join(lowest, "node", "left").select(F.col("doc_id").alias("id"), F.coalesce("low", "rep").alias("component"))
                    .where("id <> component").distinct())
    # rows that repeat an id may differ in their text; the id has one component
    return (sigs.select("doc_id", "n_shingles")
                .join(moved, F.col("doc_id") == F.col("id"), "left")
                .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
                .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def _hub_pairs(left: DataFrame) -> DataFrame:
    """(a, b): the hub a of a bucket with every other member b; linear in the bucket's rows."""
    best = F.max(F.struct(F.col("mates"), (-F.col("node")).alias("low")))
    hubs = left.groupBy("band", "h").agg((-best["low"]).alias("a"))
    return left.join(hubs, ["band", "h"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _open_families(star: DataFrame, comp: DataFrame) -> DataFrame:
    """The (hub, member) pairs of hubs that have a member outside their component."""
    of = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias("c" + c))
    both = (star.join(of("a"), "a", "left").join(of("b"), "b", "left")
                .where("coalesce(ca, a) <> coalesce(cb, b)").select("a").distinct())
    return star.join(both, "a", "left_semi").select("a", "b")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each near-duplicate group stays (5 words, 0.8), with all columns.

    Rows are grouped by their place, so null and repeated ids are rows of their own;
    the one with the smallest (id, nulls last, place) stays.
    """
    row, gone_row = C.unused([*docs.columns, "doc_id", "text"], "row", "gone_row")
    rows = C.numbered(docs, row)
    d = C.pick(rows, **{"doc_id": "long", "text": "string", row: "long"}).withColumnRenamed(row, "place")
    found = C.scratch(near_duplicates(d.select(F.col("place").alias("doc_id"), "text"))
                      .where("not kept").select(F.col("doc_id").alias("place"), "component_id"), "near-copies")
    group = found.unionByName(found.select(F.col("component_id").alias("place"), "component_id").distinct())
    group = group.join(d.select("place", "doc_id"), "place")
    first = group.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")).alias("first"))
    gone = group.join(first, "component_id").where("place <> first.place").select(F.col("place").alias(gone_row))
    return C.with_schema(rows.join(gone, F.col(row) == F.col(gone_row), "left_anti").drop(row), docs.schema)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir), width=2, per_cent=80)


QUERIES = {"op9_minhash_dedup": op9_minhash_dedup}
ORACLE = {}
