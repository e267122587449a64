"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Every document becomes the set of its distinct word shingles (64-bit hashes), a digest of that set and a
   SuperMinHash signature. The signature is made rank by rank: in rank j each element places a random fraction
   plus j at its own permutation's j-th position, and a document stops as soon as all positions are filled,
   since later ranks cannot lower them. Ranks of one element are thus correlated (each position once), which
   lowers the estimate's variance.
2. Documents with equal sets form a class; a row of its smallest id represents it. Copies go no further.
3. Bands of the signatures give buckets. Members of a bucket of bounded size are compared by signature in
   blocks, and only a spanning forest of the pairs whose estimate is near the threshold goes on; a larger
   bucket links its members to its smallest. Both only make coarse families, so nothing is lost by either.
4. Connected components of these links are the families. A family of bounded size is verified whole in one
   task: exact intersections of full sets, breadth first over what is not yet reached. A larger family is
   first tied to a few anchors, and those outside its largest component then meet all members in blocks: every
   pair across components has one such member, so no link is lost, and no task holds the family.
5. Verified links are united (alternating large-star and small-star steps on DataFrames).

Nulls and texts without words have an empty set, link with nothing and are kept. A text of fewer words than the
shingle is one shingle. Every row is grouped by its own text: rows that share an id but not the text may belong to different groups, and repeated
rows belong to one. Ids may be of any type that has an order. A null id is never the smallest one: a group without any id has a null component_id and its rows are all kept.
Very long texts are read whole. Empty tables give empty results; `groups` drops input columns beyond id and text, `deduplicated` keeps all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm import shared, textio

BANDS, ROWS = 24, 4
#: Members of a bucket that are compared by signature; a larger one only makes a coarse family.
BUCKET = 2048
#: Members and shingles of a family that one task verifies; beyond either, anchors and blocks.
FAMILY, FAMILY_SHINGLES = 512, 1_000_000
ANCHORS = 8
#: Members and shingles (about) of a block that meets all members of its family, and members that one task leads past the anchors.
BLOCK, BLOCK_SHINGLES, LED = 8192, 4_000_000, 256
#: Rows (of six numbers at most, some 20 MB) that are broadcast; more are joined by an exchange.
BROADCAST = 250_000
#: Pairs whose estimated similarity lies so far below the threshold are not linked for verification.
SLACK = 0.22


# Sets and signatures.


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and their bounds."""
    buf = textio.LOWER[buf]
    starts, ends, first = textio.word_bounds(buf, offsets, textio.NOT_SPACE)
    hashes = textio.word_hashes(buf, starts, ends)
    wide = textio.windows(hashes, width)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(wide[a : b - width + 1]))
        elif b > a:
            sets.append(textio.windows(hashes[a:b], b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=bounds[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds


def super_minhash(elements: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """A row of `size` values for each set; the high 32 bits of a value are its rank, the low ones its fraction."""
    n_sets = len(bounds) - 1
    unset = np.uint64((1 << 64) - 1)
    out = np.full(n_sets * size, unset, dtype=np.uint64)
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))

    def draw(which: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """Fraction (32 bits) and a place from `rank` to size - 1 for every element."""
        x = textio.mix(which + np.uint64((0x9E3779B97F4A7C15 * (rank + 1)) & ((1 << 64) - 1)))
        place = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(size - rank)) >> np.uint64(32)
        return x >> np.uint64(32), place.astype(np.int64) + rank

    fraction, place = draw(elements, 0)
    np.minimum.at(out, owner * size + place, fraction)
    table = None
    for rank in range(1, size):
        open_sets = (out.reshape(n_sets, size) == unset).any(axis=1)
        live = open_sets[owner]
        if not live.any():
            break
        if table is None:  # the permutations so far: rank 0 swapped place 0 with the drawn one
            elements, owner, place = elements[live], owner[live], place[live]
            table = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(elements), 1))
            rows = np.arange(len(elements))
            table[rows, place], table[:, 0] = table[:, 0].copy(), table[rows, place].copy()
        elif not live.all():
            elements, owner, table = elements[live], owner[live], table[live]
        fraction, place = draw(elements, rank)
        rows = np.arange(len(elements))
        position = table[rows, place].copy()
        table[rows, place] = table[:, rank]
        table[:, rank] = position
        np.minimum.at(out, owner * size + position.astype(np.int64), np.uint64(rank << 32) | fraction)
    return out.reshape(n_sets, size)


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """id, t (hash of the text), n_shingles, digest (null for an empty set), sketch (a byte for each position) and bands (a hash each)."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, t long, n_shingles long, digest binary, sketch binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in textio.slices(batches, "text"):
            elements, bounds = shingle_sets(buf, offsets, width)
            signature = super_minhash(elements, bounds, bands * rows)
            keys = np.zeros((len(part), bands), dtype=np.uint64)
            for r in range(rows):
                keys = textio.mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r * bands : (r + 1) * bands])
            keys = textio.mix(keys + np.arange(bands, dtype=np.uint64))
            sizes = np.diff(bounds)
            digests = [hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            sketch = (textio.mix(signature) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("t"),
                    pa.array(sizes),
                    pa.array(digests, pa.binary()),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())) if len(part) else pa.array([], pa.list_(pa.int64())),
                ],
                ["id", "t", "n_shingles", "digest", "sketch", "bands"],
            )
        textio.give_back()

    return docs.mapInArrow(run, schema)


# Links and components.


class UnionFind:
    """Groups under their smallest member."""

    def __init__(self):
        self.above: dict = {}

    def find(self, x):
        above = self.above
        root = x
        while (up := above.get(root, root)) != root:
            root = up
        while x != root:
            above[x], x = root, above.get(x, x)
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.above[b] = a
        self.above.setdefault(a, a)
        return True

    def members(self) -> list[tuple]:
        """(member, smallest of its group) for all members but the smallest."""
        return [(x, root) for x in list(self.above) if (root := self.find(x)) != x]


def _state(links: DataFrame) -> tuple:
    """Count and sum of hashes: equal only for equal links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reached) for all nodes of the links (a, b), by large-star and small-star steps until nothing changes."""
    current = shared.written(links.select("a", "b").where("a <> b").distinct(), "links", few_files=True)
    last = _state(current)
    while last[0]:
        # Large star: every larger neighbour of u, linked to the least of u and its neighbours.
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Joined on ~a: either side then has an exchange of its own, so that a node of very many links can be split.
        apart = least.select(F.bitwise_not("a").alias("k"), "m")
        large = both.where("b > a").withColumn("k", F.bitwise_not("a")).join(apart, "k").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: every smaller neighbour of u and u itself, linked to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        apart = least.select(F.bitwise_not("a").alias("k"), "m")
        small = down.withColumn("k", F.bitwise_not("a")).join(apart, "k").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        step = small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        current = shared.written(step, "links", few_files=True)
        state = _state(current)
        if state == last:
            break
        last = state
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


# Candidate families.


def estimated_forest(sketches: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows whose sketches agree in at least this share of positions."""
    n, size = sketches.shape
    need = int(np.ceil((least + (1 - least) / 256) * size))
    left = np.arange(n)
    found = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = (sketches[left] == sketches[u]).sum(axis=1) >= need
            found += [(int(u), int(v)) for v in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return found


def candidate_links(reps: DataFrame, threshold: float, bucket: int) -> DataFrame:
    """Links (a, b) whose components hold every pair at or above the threshold."""
    rows = reps.select("id", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    apart = sizes.select(F.bitwise_not("bucket").alias("k"), "n", "least")  # an exchange of its own, as in components()
    members = rows.withColumn("k", F.bitwise_not("bucket")).join(apart, "k")
    far = members.where(F.col("n") > bucket).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    lists = members.where(F.col("n") <= bucket).groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
    pairs = lists.select(F.xxhash64("ids").alias("block"), F.explode("ids").alias("id"))
    blocks = pairs.join(reps.select("id", "sketch"), "id").groupBy("block").agg(F.collect_list(F.struct("id", "sketch")).alias("m"))
    least = threshold - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = UnionFind()
            for m in batch.column("m"):
                rows = m.values
                ids = rows.field("id").to_pylist()
                sketches = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                for i, j in estimated_forest(sketches, least):
                    groups.union(ids[i], ids[j])
            found = groups.members()
            yield _links(found)
        textio.give_back()

    return blocks.select("m").mapInArrow(run, "a long, b long").unionByName(far)


# Verification on full sets.


def linked(shared_size: np.ndarray, sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    return 100 * shared_size >= percent * (sizes + size - shared_size)


def verified_groups(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(id, smallest id of its component) under exact links, for members of components of two or more."""
    if len(ids) == 2:
        a, b = sets
        common = len(np.intersect1d(a, b, assume_unique=True))
        return [(max(ids), min(ids)), (min(ids), min(ids))] if 100 * common >= percent * (len(a) + len(b) - common) else []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), sizes)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(flat.max() + 1, dtype=bool)
    component = np.arange(len(ids))
    left = np.ones(len(ids), bool)
    rest, rest_owner = flat, owner
    for seed in np.argsort(np.array(ids), kind="stable"):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            u = queue.pop()
            if len(rest) > 2 * sizes[left].sum():
                alive = left[rest_owner]
                rest, rest_owner = rest[alive], rest_owner[alive]
            if not len(rest):
                break
            own = flat[starts[u] : starts[u] + sizes[u]]
            mark[own] = True
            common = np.bincount(rest_owner[mark[rest]], minlength=len(ids))
            mark[own] = False
            near = np.flatnonzero(left & linked(common, sizes, sizes[u], percent))
            component[near] = component[u]
            left[near] = False
            queue += near.tolist()
    counts = np.bincount(component, minlength=len(ids))
    return [(ids[i], ids[c]) for i, c in enumerate(component.tolist()) if counts[c] > 1]


def sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for text in texts:
        elements, _ = shingle_sets(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), width)
        out.append(elements)
    return out


def small_families(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of families (family, id, text) that one task can hold: each is read as consecutive rows of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, ids, sets, found = None, [], [], []

        def done() -> None:
            if len(ids) > 1:
                found.extend(verified_groups(ids, sets, percent))

        for batch in batches:
            for at, id_, text in zip(*(batch.column(c).to_pylist() for c in ("family", "id", "text")), strict=True):
                if at != family:
                    done()
                    family, ids, sets = at, [], []
                ids.append(id_)
                sets += sets_of([text.encode()], width)
            if len(found) > 10_000:
                yield _links(found)
                found = []
        done()
        yield _links(found)
        textio.give_back()

    return members.repartition("family").sortWithinPartitions("family").select("family", "id", "text").mapInArrow(run, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])


def met(members: DataFrame, blocks: DataFrame, salts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between members (family, id, text) and every block (family, number, id, text) of their family.

    The members are dealt over `salts` (family, salts) tasks a block, which stream them past the block's sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, elements, owner, sizes = None, [], [], None, None, None
        for batch in batches:
            groups = UnionFind()
            for *at, kind, id_, text in zip(*(batch.column(c).to_pylist() for c in ("family", "number", "salt", "kind", "id", "text")), strict=True):
                if at != key:
                    key, ids, sets, elements = at, [], [], None
                own = sets_of([text.encode()], width)[0]
                if kind == 0:
                    ids.append(id_)
                    sets.append(own)
                    continue
                if elements is None:
                    sizes = np.array([len(s) for s in sets])
                    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(elements, kind="stable")
                    elements, owner = elements[order], owner[order]
                low, high = np.searchsorted(elements, own), np.searchsorted(elements, own, side="right")
                size = high - low
                places = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                common = np.bincount(owner[places], minlength=len(ids))
                for k in np.flatnonzero(linked(common, sizes, len(own), percent)):
                    groups.union(ids[k], id_)
            yield _links(groups.members())
        textio.give_back()

    columns = ["family", "number", "salt", "kind", "id", "text"]
    numbers = blocks.select("family", "number").distinct().join(salts, "family")
    passing = members.join(numbers, "family").withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).withColumn("kind", F.lit(1))
    held = blocks.join(salts, "family").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("kind", F.lit(0))
    dealt = passing.select(columns).unionByName(held.select(columns)).repartition("family", "number", "salt")
    return dealt.sortWithinPartitions("family", "number", "salt", "kind").mapInArrow(run, "a long, b long")


def large_families(members: DataFrame, width: int, percent: int, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) of families (family, id, n_shingles, text) of any size: anchors first, then those outside the largest component in blocks."""
    drawn = [F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"a{k}") for k in range(ANCHORS)]
    chosen = members.groupBy("family").agg(F.count("*").alias("n"), *drawn)
    chosen = shared.written(chosen, "anchors", few_files=True)
    anchors = chosen.select("family", F.explode(F.array_distinct(F.array(*[f"a{k}" for k in range(ANCHORS)]))).alias("id"))
    anchored = members.join(anchors, ["family", "id"])
    salts = chosen.select("family", F.ceil(F.col("n") / LED).alias("salts"))
    tied = shared.written(met(members.select("family", "id", "text"), anchored.select("family", F.lit(0).cast("long").alias("number"), "id", "text"), salts, width, percent), "tied", few_files=True)
    grouped = components(tied).select(F.col("node").alias("id"), "component")
    placed = members.select("family", "id", "n_shingles").join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("family", "component").count()
    largest = sizes.groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    outside = placed.join(largest, "family").where("component <> largest").select("family", "id", "n_shingles")
    # Blocks by hash: as many as keep the expected members and shingles of a block at half its bounds.
    load = outside.groupBy("family").agg(F.count("*").alias("outside"), F.greatest(F.ceil(F.count("*") * 2 / block), F.ceil(F.sum("n_shingles") * 2 / block_shingles)).alias("blocks"))
    load = shared.written(load, "load", few_files=True)
    numbered = outside.join(load, "family").select("family", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("number"))
    held = shared.written(members.join(numbered, ["family", "id"]).select("family", "number", "id", "text"), "blocks")
    # Every salt holds the blocks again: the more are outside, the more members a task leads past them.
    salts = chosen.join(load, "family").select("family", F.ceil(F.col("n") / F.greatest(F.lit(LED), F.col("outside") / 8)).alias("salts"))
    return tied.unionByName(met(members.select("family", "id", "text"), held, salts, width, percent))


def bounded(rows: DataFrame) -> DataFrame:
    """A written table of a few long columns, marked for a broadcast if it has at most BROADCAST rows; a larger one is joined by an exchange."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def groups_of_rows(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    bucket: int = BUCKET,
    family: int = FAMILY,
    family_shingles: int = FAMILY_SHINGLES,
    block: int = BLOCK,
) -> DataFrame:
    """Per row: id, t (hash of the text), n_shingles and component_id."""
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))
    signs = shared.written(signed(source, width, bands, rows), "signatures")
    classes = signs.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"))
    # Joined by id and digest, so that a class of very many rows is no hot key.
    first = classes.select(F.col("rep"), F.col("digest").alias("d"))
    own = signs.join(first, signs["id"].eqNullSafe(first["rep"]) & (signs["digest"] == first["d"]), "left_semi").dropDuplicates(["digest"])
    reps = shared.written(own.select(F.monotonically_increasing_id().alias("node"), "id", "t", "digest", "n_shingles", "sketch", "bands"), "representatives")
    nodes = reps.select(F.col("node").alias("id"), "n_shingles", "sketch", "bands")
    families = shared.written(components(candidate_links(nodes, percent / 100, bucket)).select(F.col("node").alias("id"), F.col("component").alias("family")), "families", few_files=True)
    weighed = families.join(nodes.select("id", "n_shingles"), "id")
    sizes = weighed.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    wanted = weighed.join(sizes, "family").select("family", F.col("id").alias("node"), ((F.col("n") > family) | (F.col("total") > family_shingles)).alias("large"))
    wanted = wanted.join(reps.select("node", F.col("id").alias("rep"), F.col("t").alias("u"), "n_shingles"), "node")
    wanted = shared.written(wanted, "wanted", few_files=True)
    few = bounded(wanted)
    texts = source.join(few, source["id"].eqNullSafe(few["rep"]) & (source["t"] == few["u"])).select("family", F.col("node").alias("id"), "n_shingles", "text", "large")
    texts = shared.written(texts, "texts")
    links = small_families(texts.where("NOT large"), width, percent)
    if not wanted.where("large").isEmpty():
        links = links.unionByName(large_families(texts.where("large"), width, percent, block))
    found = components(links.where("a <> b"))
    placed = reps.select("node", "id", "digest").join(found, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("k"))
    least = placed.groupBy("k").agg(F.min("id").alias("component_id"))
    apart = least.select(F.bitwise_not("k").alias("k"), "component_id")  # an exchange of its own, as in components()
    merged = placed.withColumn("k", F.bitwise_not("k")).join(apart, "k").select("digest", "component_id", F.lit(True).alias("linked"))
    out = signs.select("id", "t", "n_shingles", "digest").join(merged, "digest", "left")
    return out.select("id", "t", "n_shingles", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reached over links of at least `percent`) and kept (it is that id); parameters as of groups_of_rows."""
    found = groups_of_rows(docs, id, text, **parameters)
    return found.select(F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of the smallest id of each group, with the columns of `docs`. Rows are told apart by id and hash of the text; only these of the others are joined."""
    found = groups_of_rows(docs, id, text, **parameters)
    rest = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_id"), F.col("t").alias("_t")).distinct()
    rest = bounded(shared.written(rest, "copies", few_files=True))
    return docs.join(rest, docs[id].eqNullSafe(rest["_id"]) & (F.xxhash64(docs[text]) == rest["_t"]), "left_anti").select(docs.columns)


#: Links of all pairs that share a shingle (4 words, 80 per cent) and what they reach, for a check on small tables.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i : i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
v AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM v UNION ALL SELECT b, a FROM v),
r AS (SELECT DISTINCT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT doc_id, min(seen) AS m FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
