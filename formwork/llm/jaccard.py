"""N-gram Jaccard join: which documents share nearly all of their word n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwork.llm.common import KEYS, Rolling, Texts, keyed, row_keys, dropped, text_chunks, type_of, written
from formwork.llm.components import components


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct ``n``-word shingles (A-Z lower-cased).

    Fewer words are one shingle; no words, none."""
    t = Texts([x.lower() for x in texts])
    t.words()
    flat, starts, ends = t.spaced()
    rolling = Rolling(np.frombuffer(flat, np.uint8))
    size = max(0, len(starts) - n + 1)
    h = rolling.of(starts[:size], ends[n - 1 :]) if size else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a:
            out.append(rolling.of(starts[a : a + 1], ends[b - 1 : b]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def block_links(sets: list[np.ndarray], percent: int, columns: int = 2048, known: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of sets link: a boolean matrix, from the product of the incidence matrix and its
    transpose, some columns at a time.

    100 * overlap >= percent * union is overlap >= percent * (a + b) / (100 + percent).  After each
    block of columns a pair stays only if its count and what either set still has can reach that;
    rows without such a pair leave the product.  Pairs that are equal in ``known`` aren't compared."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    need = -(-percent * (size[:, None] + size[None, :]) // (100 + percent))
    alive = np.minimum(size[:, None], size[None, :]) >= need
    np.fill_diagonal(alive, False)
    if known is not None:
        alive &= known[:, None] != known[None, :]
    row = np.repeat(np.arange(n), size)
    values, column, often = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = often > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left = np.bincount(row, minlength=n)
    overlap = np.zeros((n, n), np.float32)
    alive &= np.minimum(left[:, None], left[None, :]) >= need
    for a in range(0, int(shared.sum()), columns):
        rows = np.flatnonzero(alive.any(axis=1))
        if not len(rows):
            break
        lo, hi = np.searchsorted(column, [a, a + columns])
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        r, c = place[row[lo:hi]], column[lo:hi] - a
        block = np.zeros((len(rows), columns), np.float32)
        block[r[r >= 0], c[r >= 0]] = 1
        overlap[np.ix_(rows, rows)] += block @ block.T
        left = left - np.bincount(row[lo:hi], minlength=n)
        alive &= overlap + np.minimum(left[:, None], left[None, :]) >= need
    return alive & (overlap >= need)


def _least_reachable(links: np.ndarray) -> np.ndarray:
    """For each row the least row it is connected with."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90, block: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Links documents whose ``n``-word shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id`` for each row: the size of its set and the smallest
    id reachable by links, itself included.  Ids may be of any type that has an order.

    Exact up to collisions of 64-bit hashes, and linear in the input but for what links:

    1. Equal sets are one node.
    2. A node sends a slice of its shingles (``sample_of``).  Those of the slice that no other node
       has bound what it can share; nodes that can't reach ``percent`` go.  In the order of how many
       nodes have a shingle, rarest first, linked nodes share one of their first few (``prefixes``).
       The nodes that remain send all their shingles and are sifted in the same way.
    3. In each list of nodes with such a shingle all are held against one of them, its head, by
       blocks of the sparse product (``linked``).  What links is one component, so groups of near
       copies end here.
    4. Lists that still have several components hold the nodes outside the largest against all
       others of the list, where sizes and bounds allow a link: lists of up to ``PAIRED`` nodes pair
       by pair, longer ones by tiles of the sparse product (``tiled``), so that no row is made for
       each pair.

    Each product returns the links of a spanning forest at most, components need no more, and only
    verified links make components.

    Documents without words (or null) are linked with nothing.  Rows that share an id are one node
    for ``component_id`` only if their texts link.  Null ids keep a null component unless they link
    with an id.  Very long texts count whole; an empty table gives no rows; other columns are ignored.
    """
    rows, found = linked_classes(keyed(docs, id_column, text_column), n, percent, block)
    return _labelled(rows, found).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, block: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group that ``near_duplicates`` links: the least id's.

    Equal rows are a group, rows that share an id but aren't linked are not; rows with a null id
    only stand for a group without ids.  Documents without words stay, all of them.  Columns keep
    their names, whatever they are."""
    rows, found = linked_classes(keyed(docs, id_column, text_column), n, percent, block)
    rows = _labelled(rows, found)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *KEYS)).alias("c")
    stay = rows.filter("component is not null").groupBy("component").agg(first).select(*(f"c.{k}" for k in KEYS), F.lit(True).alias("one"))
    stay = stay.unionByName(rows.filter("component is null").select(*KEYS, F.lit(False).alias("one")).distinct())
    marked = docs.select(F.struct("*").alias("row"), *row_keys(id_column, text_column))
    found = marked.join(stay.hint("merge"), KEYS).withColumn("number", F.when(F.col("one"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return found.dropDuplicates([*KEYS, "number"]).select("row.*")


#: Lists of up to so many nodes are expanded into pairs.
PAIRED = 32


def sample_of(percent: int) -> float:
    """The share of the shingle space that nodes send: more than the share a set can lack."""
    return min(1.0, (100 - percent) / 100 + 0.07)


def _sample_limit(percent: int) -> int:
    return min((1 << 64) - 1, int(sample_of(percent) * 2.0**64))


def _least_overlap(size: Column, percent: int) -> Column:
    """What a set of this size has in common with any set it links with, at least."""
    return F.ceil(size * percent / F.lit(100)).cast("int")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes ``n`` and bounds ``most`` of two rows allow a link."""
    need = F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    return F.least(f"{a}.most", f"{b}.most") * F.lit(100 + percent) >= need


def sized_sets(texts: DataFrame, n: int) -> DataFrame:
    """``doc_id``, keys, ``n_shingles, node`` of each text; ``node`` hashes the whole set."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for part, chunk in text_chunks(batches, 512 << 10):
            sets = shingle_sets(chunk, n)
            kept = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", *KEYS)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(s) for s in sets], pa.int64()), _nodes(sets)], ["doc_id", *KEYS, "n_shingles", "node"])

    return texts.mapInArrow(rows, f"doc_id {type_of(texts, 'doc_id')}, key_a long, key_b long, n_shingles long, node long")


def samples(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``node, n, sample`` of each text with words: its least hashes, sorted, those below a fixed
    bound (``sample_of``) and as many more as a prefix needs."""
    limit = np.uint64(_sample_limit(percent))

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for _, chunk in text_chunks(batches, 512 << 10):
            sets = [s for s in shingle_sets(chunk, n) if len(s)]
            take = [max(int(np.searchsorted(s, limit)), len(s) - -(-percent * len(s) // 100) + 1) for s in sets]
            yield pa.RecordBatch.from_arrays([_nodes(sets), pa.array([len(s) for s in sets], pa.int64()), _lists([s[:k] for s, k in zip(sets, take)])], ["node", "n", "sample"])

    return texts.select("text").mapInArrow(rows, "node long, n long, sample array<long>")


def whole_sets(texts: DataFrame, n: int) -> DataFrame:
    """``node, n, tokens`` from ``node, text``."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for part, chunk in text_chunks(batches, 512 << 10):
            sets = shingle_sets(chunk, n)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("node")), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["node", "n", "tokens"])

    return texts.mapInArrow(rows, "node long, n long, tokens array<long>")


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets], pa.int64())


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def prefixes(nodes: DataFrame, percent: int, whole: bool) -> DataFrame:
    """``token, node, n, most``: shingles of which linked nodes share one, from ``node, n, sample``.

    The order of all shingles: those below the sample's bound first (``whole``: all are), by how
    many nodes have them, then the others by hash.  Shingles of one node alone come first and share
    nothing: they take places of the prefix.  ``most`` bounds what a set can share if this shingle
    is the first shared one: all that comes before isn't."""
    limit = _sample_limit(percent)
    below = F.lit(True) if whole else F.col("token").between(0, limit - 1) if limit < 1 << 63 else (F.col("token") >= 0) | (F.col("token") < limit - (1 << 64))
    rows = nodes.select("node", "n", F.size("sample").alias("sent"), F.explode("sample").alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("often")).filter("often > 1")
    later = F.when(below, F.col("often")).otherwise(F.lit(1 << 60))
    held = rows.join(often, "token").groupBy("node", "n", "sent").agg(F.sort_array(F.collect_list(F.struct(later.alias("often"), F.col("token")))).alias("shared"))
    # Where a set has fewer shingles below the bound than its prefix is long, the prefix is all it sent.
    places = F.col("n") - _least_overlap(F.col("n"), percent) + 1
    alone = F.when(F.lit(whole) | (F.col("sent") > places), F.col("sent") - F.size("shared")).otherwise(F.lit(0))
    held = held.withColumn("alone", alone).filter(F.col("n") - F.col("alone") >= _least_overlap(F.col("n"), percent))
    first = F.slice("shared", 1, F.greatest(F.lit(0), places - F.col("alone")).cast("int"))
    most = (F.col("n") - F.col("alone") - F.col("at")).alias("most")
    return held.select("node", "n", "alone", F.posexplode(first).alias("at", "t")).select("t.token", "node", "n", most)


def linked_classes(texts: DataFrame, n: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """For each text (``keyed``) ``doc_id``, keys, ``n_shingles, node``; and the components
    (node, component) of the nodes that link."""
    # Where both sides of a join grow with the input, neither is broadcast at any size.
    rows = written(sized_sets(texts, n))
    nodes = written(samples(texts, n, percent).dropDuplicates(["node"]))
    lists = prefixes(nodes, percent, False)
    several = lists.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("token")
    candidates = written(lists.join(several.hint("merge"), "token").select("node").distinct())
    dropped(nodes)
    chosen = rows.join(candidates.hint("merge"), "node").groupBy("node").agg(F.min(F.struct(*KEYS)).alias("c")).select("node", "c.*")
    some = texts.select(*KEYS, "text").join(chosen.hint("merge"), KEYS).dropDuplicates(KEYS).select("node", "text")
    sets = written(whole_sets(some, n))
    dropped(candidates)
    lists = prefixes(sets.select("node", "n", F.col("tokens").alias("sample")), percent, True)
    lists = written(lists)
    heads = lists.groupBy("token").agg(F.min(F.struct("node", "n", "most")).alias("head"), F.max("node").alias("last")).filter("head.node <> last").drop("last")
    lists = written(lists.join(heads.hint("merge"), "token"))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    me = lists.select("head", F.struct("node", "n", "most").alias("own")).filter("own.node <> head.node")
    with_head = written(me.filter(_may_link("own", "head", percent)).select(*pair("head.node", "own.node")).distinct())
    links = written(linked(with_head, sets, percent, block))

    label = components(links)
    members = lists.join(label, "node", "left").select("token", F.col("head.node").alias("head"), "node", "n", "most", F.coalesce("component", "node").alias("component"))
    shares = members.groupBy("token", "component").agg(F.count("*").alias("members")).groupBy("token").agg(F.max(F.struct("members", "component"))["component"].alias("major"), F.count("*").alias("several"), F.sum("members").alias("held")).filter("several > 1").drop("several")
    mixed = written(members.join(shares, "token"))
    short = mixed.filter(F.col("held") <= PAIRED)
    left = short.filter("component <> major").select("token", "major", F.struct("node", "n", "most", "component").alias("l"))
    right = short.select("token", F.struct("node", "n", "most", "component").alias("r"))
    across = (F.col("l.component") != F.col("r.component")) & ((F.col("r.component") == F.col("major")) | (F.col("l.node") < F.col("r.node")))
    others = left.join(right, "token").filter(across & _may_link("l", "r", percent)).select(*pair("l.node", "r.node")).distinct()
    others = written(others.join(with_head, ["a", "b"], "left_anti"))
    found = tiled(mixed.filter(F.col("held") > PAIRED), sets, percent, block)
    return rows, components(links.unionByName(linked(others, sets, percent, block)).unionByName(found))


def linked(pairs: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) by which the pairs (a, b) that link are connected; ``sets`` (node, tokens).

    A node and those it is paired with, ``block`` at a time, are one block of the sparse product;
    small blocks travel together.  A node with very many partners is copied once for each block."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    total = pairs.count()
    bundles = F.lit(max(1, total // (2 * block)))
    blocks = F.ceil(F.col("partners") / block).cast("int")
    some = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), blocks).cast("int"))
    own = counts.select("a", F.col("a").alias("node"), "partners", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"))
    members = some.select("a", F.col("b").alias("node"), "partners", "part").unionByName(own)
    alone = F.col("partners") > block // 4
    tile = F.when(alone, F.xxhash64("a", "part")).otherwise(F.pmod(F.xxhash64("a"), bundles))
    tiles = members.withColumn("tile", tile).join(sets.hint("merge"), "node").select("tile", "a", "part", "node", "tokens")

    def link(rows: pa.Table) -> pa.Table:
        group, part, node = (rows.column(c).to_numpy() for c in ("a", "part", "node"))
        sets = _sets_of(rows)
        order = np.lexsort((node, part, group))
        cuts = np.flatnonzero(np.append(True, (np.diff(group[order]) != 0) | (np.diff(part[order]) != 0)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            own = order[lo:hi]
            label = _least_reachable(block_links([sets[i] for i in own.tolist()], percent))
            linked = np.flatnonzero(label != np.arange(len(label)))
            a.append(node[own[linked]])
            b.append(node[own[label[linked]]])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return tiles.groupBy("tile").applyInArrow(link, "a long, b long")


def tiled(lists: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) by which nodes of one list and different components are connected;
    ``lists`` (head, node, component), ``sets`` (node, tokens).

    Lists with the same head are one.  Its nodes outside the largest component are dealt into parts
    of about half a ``block``, and so are all its nodes; each two parts are one tile of the sparse
    product.  A node is copied once for each part of the other side, not for each partner."""
    half = max(1, block // 2)
    nodes = lists.select("head", "node", "component").distinct()
    shares = nodes.groupBy("head", "component").agg(F.count("*").alias("members")).groupBy("head").agg(F.max(F.struct("members", "component")).alias("major"), F.sum("members").alias("held"))
    dealt = nodes.join(shares, "head").withColumn("outer", F.ceil((F.col("held") - F.col("major.members")) / half).cast("int")).withColumn("all", F.ceil(F.col("held") / half).cast("int"))
    part = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = dealt.filter("component <> major.component").select("head", "node", "component", part("outer").alias("i"), each("all").alias("j"))
    right = dealt.filter("outer > 0").select("head", "node", "component", each("outer").alias("i"), part("all").alias("j"))
    tiles = left.unionByName(right).withColumn("tile", F.xxhash64("head", "i", "j")).join(sets.hint("merge"), "node").select("tile", "node", "component", "tokens")

    def link(rows: pa.Table) -> pa.Table:
        node, first = np.unique(rows.column("node").to_numpy(), return_index=True)
        sets, component = _sets_of(rows), rows.column("component").to_numpy()
        label = _least_reachable(block_links([sets[i] for i in first.tolist()], percent, known=component[first]))
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(node[linked]), "b": pa.array(node[label[linked]])})

    return tiles.groupBy("tile").applyInArrow(link, "a long, b long")


def _sets_of(rows: pa.Table) -> list[np.ndarray]:
    """Views of the column ``tokens``."""
    tokens = rows.column("tokens").combine_chunks()
    flat, cut = tokens.values.to_numpy().view(np.uint64), tokens.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``component`` and ``component_id``, its least id; both null without shingles."""
    node = F.when(F.col("n_shingles") > 0, F.col("node"))
    rows = rows.withColumn("node", node)
    low = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    grouped = low.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    labels = grouped.join(least, "component").select("node", "component", "component_id")
    return rows.join(labels, "node", "left")
