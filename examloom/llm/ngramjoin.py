"""N-gram Jaccard join: prefix trees over word shingles.

A document's set holds its distinct k-word shingles as 64-bit hashes; sets link when Jaccard >= percent / 100. Equal
sets are one node. In a global order (rare shingles first, by a count sketch of the whole corpus, then by hash), two
sets that link share a shingle among their first n - ceil(t n) + 1. Shingles that only one set has there are dropped.

Every set with a shared shingle goes once, whole, to the block of its commonest one, with at most about `block_rows`
sets to a block. A block is a prefix tree: its sets, most frequent shingles first, share the nodes of their common
beginnings. Each set walks the tree, adding up overlaps that hold for all sets below a node, and leaves a subtree when
the shingles left on either side can't reach the overlap that its sizes ask for, or when it holds only sets that are
known to belong together. Blocks of one large family are tied together through their central sets. Then a set visits
another block only if it shares a prefix shingle with a set there that isn't in its component yet, and is itself outside
the component of most sets with that shingle. So every linked pair is compared or already connected, and no pairs of a
group are written out.

Defined cases: null or wordless text has an empty set and links with nothing; a text with fewer than k words is one
shingle; repeated rows and equal texts are one component; null ids are ignored for the smallest id of a component
(null if there is no other); an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import KEY, aside, chunks, keyed, share, shared, small
from .graph import components

SKETCH_BITS, SKETCH_ROWS = 20, 256
#: Groups of up to so many sets are searched for partners that could link before any text is sent around.
PRUNE_ROWS = 1024
#: So many sets visit one copy of a block.
PROBES = 1000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Hashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], k: int, hashes: Hashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        ws = t.lower().split() if t else []
        sizes.append(len(ws))
        words += ws
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        h = mix(a[: max(0, len(a) - k + 1)] + np.uint64(k))
        for j in range(1, k):
            h = mix(h + a[j : j + len(h)])
        out, at = [], 0
        for n in sizes:
            if n >= k:
                out.append(np.unique(h[at : at + n - k + 1]))
            elif n:
                x = mix(a[at : at + 1] + np.uint64(1000 + n))
                for j in range(1, n):
                    x = mix(x + a[at + j])
                out.append(x)
            else:
                out.append(a[:0])
            at += n
    return out


def needed(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of these sizes: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


class Node:
    __slots__ = ("part", "seg", "kids", "sids", "low", "deep", "comp")

    def __init__(self, part: list[int]):
        self.part, self.seg = part, frozenset(part)
        self.kids: dict[int, Node] = {}
        self.sids: list[int] = []
        self.low, self.deep, self.comp = 1 << 60, 0, -1


class Tree:
    """A compressed prefix tree of sets of ranks, walked by other sets of ranks."""

    def __init__(self, percent: int):
        self.percent, self.root, self.size, self.parent = percent, Node([]), {}, {}

    def find(self, s: int) -> int:
        p = self.parent
        while p[s] != s:
            p[s] = p[p[s]]
            s = p[s]
        return s

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def one(self, node: Node) -> int:
        """The component of all sets below the node if known to be one, else -1."""
        return self.find(node.comp) if node.comp >= 0 else -1

    def insert(self, sid: int, ranks: list[int], n: int) -> None:
        self.size[sid] = n
        node, at, deep = self.root, 0, len(ranks)
        path = [node]
        while at < deep:
            kid = node.kids.get(ranks[at])
            if kid is None:
                kid = node.kids[ranks[at]] = Node(ranks[at:])
                at = deep
            else:
                k, part = 0, kid.part
                most = min(len(part), deep - at)
                while k < most and part[k] == ranks[at + k]:
                    k += 1
                if k < len(part):  # split the node
                    top = node.kids[ranks[at]] = Node(part[:k])
                    kid.part, kid.seg = part[k:], frozenset(part[k:])
                    top.kids[part[k]] = kid
                    top.low, top.deep, top.comp = kid.low, kid.deep, kid.comp
                    kid = top
                at += k
            node = kid
            path.append(node)
        node.sids.append(sid)
        c = self.find(sid)
        for x in path:
            new = x.deep == 0 and x.low == 1 << 60
            x.comp = c if new or self.one(x) == c else -1
            x.low, x.deep = min(x.low, n), max(x.deep, deep)

    def walk(self, sid: int, ranks: list[int], n: int) -> None:
        """Join `sid` with every set in the tree that it links to and isn't connected with yet."""
        mine, percent = frozenset(ranks), self.percent
        stack = [(self.root, 0, 0, 0)]  # node, shingles above it, overlap above it, own shingles up to there
        visited = []
        while stack:
            node, depth, overlap, used = stack.pop()
            if node.comp >= 0 and self.find(node.comp) == self.find(sid):
                continue
            visited.append(node)
            depth += len(node.part)
            overlap += len(mine & node.seg)
            if node.part:
                used = bisect_right(ranks, node.part[-1])
            for s in node.sids:
                m = self.size[s]
                if overlap >= needed(n, m, percent) and self.find(s) != self.find(sid):
                    self.union(s, sid)
            left = len(ranks) - used
            # kids added later are visited later: the first sets are the central ones
            for kid in reversed(node.kids.values()):
                if overlap + min(left, kid.deep - depth) >= needed(n, kid.low, percent):
                    stack.append((kid, depth, overlap, used))
        for node in reversed(visited):  # subtrees that have become one component
            if node.comp < 0:
                seen = {self.find(s) for s in node.sids} | {self.one(k) for k in node.kids.values()}
                if len(seen) == 1:
                    node.comp = seen.pop()


def ranked(sets: list[np.ndarray]) -> tuple[list[list[int]], np.ndarray]:
    """Each set as ranks of shingles that more than one set has, commonest first; and how central each set is."""
    tokens, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((tokens, -counts))
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.arange(len(tokens))
    common = counts > 1
    out, weight, at = [], [], 0
    for s in sets:
        mine = where[at : at + len(s)]
        at += len(s)
        weight.append(counts[mine].sum() / max(1, len(s)))
        mine = mine[common[mine]]
        out.append(np.sort(rank[mine]).tolist())
    return out, np.array(weight)


def join_block(sids: list[int], sets: list[np.ndarray], percent: int, known: dict[int, int], probe: list[bool]):
    """Roots after joining the sets of a block, the probes only against the others. known: earlier components."""
    ranks, weight = ranked(sets)
    tree = Tree(percent)
    for s in sids:
        tree.parent[s] = s
    first: dict[int, int] = {}
    for s in sids:
        tree.union(s, first.setdefault(known[s], s))
    order = sorted(range(len(sids)), key=lambda k: (probe[k], -weight[k], sids[k]))
    for k in order:
        tree.walk(sids[k], ranks[k], len(sets[k]))
        if not probe[k]:
            tree.insert(sids[k], ranks[k], len(sets[k]))
    return [tree.find(s) for s in sids], weight


def blocks(it, k: int):
    """Whole blocks of an Arrow stream that is sorted by block: columns and shingle sets."""
    hashes, rows, sets, now = Hashes(), [], [], None
    for batch in it:
        for piece, texts in chunks([batch], "text", 2 << 20):
            got = shingle_sets(texts, k, hashes)
            for r, s in zip(piece.select([c for c in piece.schema.names if c != "text"]).to_pylist(), got, strict=True):
                if r["block"] != now and rows:
                    yield rows, sets
                    rows, sets = [], []
                now = r["block"]
                rows.append(r)
                sets.append(s)
    if rows:
        yield rows, sets


def shared_least(n: Column, low: Column, high: Column, percent: int) -> Column:
    """Least number of shared prefix shingles of linked sets, one of size n and one of a size from low to high.

    A partner of size m asks for an overlap, of which all but the shingles behind the larger set's prefix are in both
    prefixes. That grows with m up to n. Beyond n it falls by p^2 / 100 (100 + p) a step, up to the two ceilings, so it is
    least at one of the last sizes.
    """
    asks = lambda m: F.ceil(percent * (n + m) / (100 + percent)) - F.ceil(percent * F.greatest(n, m) / 100) + 1
    last = range(100 * (100 + percent) // percent**2 + 1)
    return F.least(asks(low), *(asks(F.greatest(high - j, low)) for j in last))


def could_link(
    n: np.ndarray, pos: np.ndarray, before: np.ndarray, every: np.ndarray, group: np.ndarray, percent: int
) -> np.ndarray:
    """Rows, sorted by group, with a partner in their group that could link.

    A partner's size must be near enough, and the overlap must be in reach: this shingle, the shingles before it that
    other sets have too, and all shingles behind it; and as well all shared shingles of the prefix (`every`) and all
    shingles behind the prefix. Groups of over PRUNE_ROWS rows are kept whole.
    """
    size = np.bincount(group)[group] if len(group) else group
    ok = size > PRUNE_ROWS
    i, d = np.flatnonzero(~ok), 1
    while True:
        i = i[i + d < len(group)]
        i = i[group[i + d] == group[i]]
        if not len(i):
            return ok
        a, b = n[i], n[i + d]
        most = 1 + np.minimum(before[i], before[i + d]) + np.minimum(a - pos[i], b - pos[i + d]) - 1
        most = np.minimum(most, np.minimum(every[i], every[i + d]) - (-percent * np.maximum(a, b) // 100) - 1)
        fits = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (most >= -(-percent * (a + b) // (100 + percent)))
        ok[i[fits]] = True
        ok[i[fits] + d] = True
        d += 1


def pruned(live: DataFrame, percent: int) -> DataFrame:
    """The rows (token, sid, n, pos, m) that could link, with the shared shingles `before` and of the whole prefix
    (`every`); no pair is written.

    m counts the sets of a token. Sets with a very common token meet in groups of near sizes only.
    """
    order = W.partitionBy("sid").orderBy("pos")
    rows = live.drop("before", "every").withColumns(
        {"before": F.row_number().over(order).cast("long") - 1, "every": F.count("*").over(W.partitionBy("sid"))}
    )
    band = F.floor(F.log("n") / F.lit(1.0001 * math.log(100 / percent)))
    bands = F.when(F.col("m") > PRUNE_ROWS, F.array(band, band + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    rows = rows.withColumn("band", F.explode(bands))

    def run(it):
        rest, large = None, None
        for batch in it:
            now = pa.Table.from_batches([batch])
            if large and now.num_rows:  # goes on with a group that is kept whole
                first = starts(now)
                end = int(first[1]) if len(first) > 1 else now.num_rows
                if (now["token"][0].as_py(), now["band"][0].as_py()) == large:
                    yield from now.slice(0, end).to_batches()
                    now = now.slice(end)
            rest = now if rest is None else pa.concat_tables([rest, now])
            if not rest.num_rows:
                continue
            start, large = int(starts(rest)[-1]), None
            if rest.num_rows - start > PRUNE_ROWS:
                large = rest["token"][start].as_py(), rest["band"][start].as_py()
                start = rest.num_rows
            yield from keep(rest.slice(0, start))
            rest = rest.slice(start)
        if rest is not None:
            yield from keep(rest)

    def starts(rows):
        token, band = rows["token"].to_numpy(), rows["band"].to_numpy()
        return np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (band[1:] != band[:-1])]))

    def keep(rows):
        if rows.num_rows:
            first = np.zeros(rows.num_rows, np.int64)
            first[starts(rows)] = 1
            n, pos, before, every = (rows[c].to_numpy() for c in ("n", "pos", "before", "every"))
            ok = could_link(n, pos, before, every, np.cumsum(first) - 1, percent)
            yield from rows.filter(pa.array(ok)).to_batches()

    rows = rows.repartition("token", "band").sortWithinPartitions("token", "band").mapInArrow(run, rows.schema)
    plain, twice = rows.where("band = -1"), rows.where("band >= 0").dropDuplicates(["token", "sid"])
    left = materialize(plain.unionByName(twice).drop("m", "band"), "live")
    # tokens of a single set are of no more use
    common = left.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    return materialize(left.join(common, "token"), "live")


def sketch(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Counts of all shingles of the corpus in 2 ** 20 counters, summed in the tasks and then by slice."""
    width = (1 << SKETCH_BITS) // SKETCH_ROWS

    def count(it):
        hashes, total = Hashes(), np.zeros(1 << SKETCH_BITS, np.int64)
        for _, texts in chunks(it, "_text", 2 << 20):
            every = np.concatenate(shingle_sets(texts, k, hashes))
            np.add.at(total, (every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        rows = total.reshape(SKETCH_ROWS, width)
        cols = [pa.array(range(SKETCH_ROWS), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["slice", "counts"])

    def add(it):
        total: dict[int, np.ndarray] = {}
        for batch in it:
            for s, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(c, np.int64)
                total[s] = total[s] + x if s in total else x
        cols = [pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["slice", "counts"])

    kind = "slice int, counts binary"
    rows = docs.select(F.col(text).alias("_text")).mapInArrow(count, kind)
    rows = rows.repartition(SKETCH_ROWS, "slice", F.floor(F.rand(1) * 8)).mapInArrow(add, kind)
    got = rows.repartition(SKETCH_ROWS, "slice").mapInArrow(add, kind).collect()
    total = np.zeros((SKETCH_ROWS, width), np.int64)
    for r in got:
        total[r[0]] = np.frombuffer(r[1], np.int64)
    return total.ravel()


def visiting(rows: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Which set visits which block for which token: (sid, visit, token). rows: those of `pruned` with the set's block.

    A token's main component, that of most of its sets, is visited by all its other sets, so its own stay where they are.
    Of two others in different components the one of the higher block visits the other's block.
    """
    known = rows.join(comp, "sid")
    mains = known.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.max(F.struct("c", "comp")).alias("x"), F.count("*").alias("z")
    )
    known = known.join(mains.where("z > 1").select("token", F.col("x.comp").alias("main")), "token")
    there = known.groupBy("token", F.col("block").alias("visit"), (F.col("comp") == F.col("main")).alias("is_main")).agg(
        F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max("before").alias("b_high"),
        F.max(F.col("n") - F.col("pos")).alias("rest_high"), F.max("every").alias("e_high"),
        F.min("comp").alias("c_low"), F.max("comp").alias("c_high"),
    )
    # the least overlap that a partner in the block asks for, and the most that is in reach
    least = F.greatest("n_low", F.ceil(F.col("n") * percent / 100))
    most = F.least("n_high", F.floor(F.col("n") * 100 / percent))
    asks = lambda m: F.ceil(percent * (F.col("n") + m) / (100 + percent))
    asked = asks(least)
    shared_asked = shared_least(F.col("n"), least, most, percent)
    reach = F.least("before", "b_high") + F.least(F.col("n") - F.col("pos"), "rest_high")
    visits = known.where("comp != main").join(there, "token").where(
        (reach >= asked)
        & (F.least("every", "e_high") >= shared_asked)
        & ((F.col("visit") < F.col("block")) | F.col("is_main") & (F.col("visit") != F.col("block")))
        & ((F.col("c_low") != F.col("comp")) | (F.col("c_high") != F.col("comp")))
        & (F.col("n") * percent <= F.col("n_high") * 100)
        & (F.col("n_low") * percent <= F.col("n") * 100)
    )
    return visits.select("sid", "visit", "token").distinct()


def link(docs: DataFrame, text: str, keep: list[str], k: int, percent: int, block_rows: int = 200) -> DataFrame:
    """`keep`, the row key, n_shingles and _set (a node; null for an empty set) and _root (its component's node).

    `docs` must be the result of `keyed`.
    """
    spark = docs.sparkSession
    counts = share(spark, np.log2(np.maximum(sketch(docs, text, k), 1)).astype(np.uint8))

    def prefixes(it):
        hashes, bucket = Hashes(), shared(counts)
        for batch, texts in chunks(it, "_text", 2 << 20):
            names, sizes, heads = [], [], []
            for s in shingle_sets(texts, k, hashes):
                n = len(s)
                sizes.append(n)
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if n else None)
                order = np.argsort(bucket[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                heads.append(s[order[: n - -(-percent * n // 100) + 1]].view(np.int64) if n else s.view(np.int64))
            cols = [batch.column(c) for c in columns]
            cols += [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, [*columns, "_name", "n_shingles", "_head"])

    columns = [*keep, *KEY]
    source = docs.select(*columns, F.col(text).alias("_text"))
    kinds = dict(source.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "_name string, n_shingles long, _head array<long>"])
    rows = materialize(source.mapInArrow(prefixes, schema), "sets")
    nodes = rows.where("_name is not null").groupBy("_name").agg(
        F.min(F.struct(*KEY)).alias("_at"), F.first("n_shingles").alias("n"), F.first("_head").alias("_head")
    )
    nodes = materialize(nodes.withColumn("sid", F.monotonically_increasing_id()), "nodes")

    heads = nodes.select("sid", "n", F.posexplode("_head").alias("pos", "token"))
    common = heads.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    live = heads.join(common, "token").select("token", "sid", "n", "pos", "m")
    for _ in range(3):  # what a turn drops no longer counts as shared in the next
        live = pruned(live, percent)

    # home blocks: the commonest shingle of a set, but for those far commoner than most of its own, which join families
    ranks = live.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("m", "token"))).alias("r"))
    middle = F.element_at("r", F.floor((F.size("r") + 1) / 2).cast("int"))["m"]
    home = ranks.select("sid", F.array_max(F.filter("r", lambda x: x["m"] <= 2 * middle)).alias("h")).select("sid", "h.*")
    parts = F.ceil(F.col("m") / block_rows)
    home = home.select("sid", "token", F.pmod(F.xxhash64("sid"), parts).alias("part"), parts.alias("parts"))
    home = home.withColumn("block", F.xxhash64("token", "part"))
    places = materialize(nodes.select("sid", "_at.*").join(home, "sid"), "places")
    texts = docs.select(*KEY, F.col(text).alias("text")).join(small(places), KEY)
    texts = materialize(texts.select("sid", "token", "part", "parts", "block", "text"), "texts")

    def join(it):
        for got, sets in blocks(it, k):
            sids = [r["sid"] for r in got]
            roots, weight = join_block(sids, sets, percent, {r["sid"]: r["known"] for r in got}, [r["probe"] for r in got])
            cols = [pa.array(sids, pa.int64()), pa.array(roots, pa.int64()), pa.array(weight, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["sid", "root", "weight"])

    def joined(rows: DataFrame) -> DataFrame:
        """rows: block, sid, known, probe, text."""
        rows = rows.repartition("block").sortWithinPartitions("block")
        return materialize(rows.mapInArrow(join, "sid long, root long, weight double"), "roots")

    def with_texts(rows: DataFrame) -> DataFrame:
        return joined(texts.select("sid", "text").join(small(rows), "sid"))

    at_home = joined(texts.select("block", "sid", F.col("sid").alias("known"), F.lit(False).alias("probe"), "text"))
    edges = [at_home.select("sid", "root")]

    # families of several blocks: the central set of each block's largest component meets those of other blocks
    wide = home.where("parts > 1").join(at_home, "sid")
    sized = wide.groupBy("token", "part", "parts", "root").agg(
        F.count("*").alias("c"), F.max(F.struct("weight", "sid")).alias("w")
    )
    reps = sized.groupBy("token", "part", "parts").agg(F.max(F.struct("c", "w.sid")).alias("x"))
    reps = materialize(reps.select("token", "part", "parts", "x.sid"), "reps")
    most = reps.agg(F.max("parts")).first()[0] or 1
    fan = 1
    while most > 1:
        fan *= block_rows
        near = reps.where(F.col("part") % max(1, fan // block_rows) == 0)
        near = near.select("sid", F.xxhash64("token", F.floor(F.col("part") / fan)).alias("block"))
        near = near.withColumns({"known": F.col("sid"), "probe": F.lit(False)})
        edges.append(with_texts(materialize(near, "near")).select("sid", "root"))
        most = -(-most // block_rows)

    def roots(edges: list[DataFrame]) -> DataFrame:
        all_edges = edges[0]
        for e in edges[1:]:
            all_edges = all_edges.unionByName(e)
        found = components(all_edges, "sid", "root")
        lone = places.select("sid").join(found, places["sid"] == found["node"], "left")
        return materialize(lone.select("sid", F.coalesce("root", "sid").alias("comp")), "comps")

    comp = roots(edges)
    visits = materialize(visiting(live.join(home.select("sid", "block"), "sid"), comp, percent), "visits")
    met = visits.select("token", F.col("visit").alias("block")).distinct()
    inside = live.select("token", "sid").join(home.select("sid", "block"), "sid").join(met, ["token", "block"])
    inside = inside.select("block", "sid").distinct()
    probes = visits.select(F.col("visit").alias("block"), "sid").distinct()
    # a block that very many sets visit is copied, so that no task holds more than PROBES of them
    turns = probes.groupBy("block").agg(F.ceil(F.count("*") / PROBES).alias("turns"))
    inside = inside.join(turns, "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "sid", F.lit(False).alias("probe")
    )
    probes = probes.join(turns, "block").select(
        "block", F.pmod(F.xxhash64("sid"), "turns").alias("turn"), "sid", F.lit(True).alias("probe")
    )
    both = inside.unionByName(probes).join(comp, "sid").select(
        F.xxhash64("block", "turn").alias("block"), "sid", "probe", F.col("comp").alias("known")
    )
    edges.append(with_texts(materialize(both, "both")).select("sid", "root"))
    edges.append(comp.select("sid", F.col("comp").alias("root")))
    comp = roots(edges)

    named = nodes.select("_name", "sid").join(comp, "sid", "left").select(
        "_name", F.col("sid").alias("_set"), F.coalesce("comp", "sid").alias("_root")
    )
    return rows.drop("_head").join(named, "_name", "left").drop("_name")


def report(docs: DataFrame, doc_id: str, text: str, k: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest id of its component."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(link(keyed(docs.select(doc_id, text), "join-input"), text, [doc_id], k, percent), "linked")
    least = rows.where("_root is not null").groupBy("_root").agg(F.min(doc_id).alias("component_id"))
    return rows.join(least, "_root", "left").select(
        doc_id, "n_shingles", F.when(F.col("_root").isNull(), F.col(doc_id)).otherwise(F.col("component_id")).alias("component_id")
    )


def distinct(docs: DataFrame, doc_id: str, text: str, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id (then the first row); empty texts all stay."""
    plain, names, back = aside(docs)
    rows, doc_id, text = keyed(plain, "join-input"), names[doc_id], names[text]
    with scratch(docs.sparkSession) as stay:
        linked = stay(link(rows, text, [doc_id], k, percent), "linked")
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), *KEY)
    first = linked.where("_root is not null").groupBy("_root").agg(F.min(order).alias("_first"))
    gone = linked.join(first, "_root").where(
        (F.col("_first")[KEY[0]] != F.col(KEY[0])) | (F.col("_first")[KEY[1]] != F.col(KEY[1]))
    )
    return back(rows.join(gone.select(*KEY), KEY, "left_anti"))
