"""Exact Jaccard self-join over word shingles by a token-group matrix.

1. Documents with the same words are one class; one row of it, its representative, stands for all.
2. Representatives with similar sketches are gathered around a centre into groups, and large groups are cut into chunks
   of bounded size. Grouping only steers the work, the result does not depend on it.
3. A chunk holds the token union of its members as an index from token to members. Inside a chunk all overlaps are
   counted by it. In a cut group, all members of one chunk are asked against each other chunk, two chunks at a time.
4. Between groups, prefixes lead: in one order of all tokens, two sets with J >= 4/5 share a token among the first
   n - ceil(4n/5) + 1 of each. Tokens that a sample shows to be common go last in this order, so shared passages do
   not lead to candidates. A token met in different groups makes its document a query to the other group.
5. A query opens a chunk only if its overlap with the chunk's token union reaches what the smallest member would need;
   then overlaps with all members are counted exactly.
6. Every pair is asked once, so sums of what is found, weighted by class sizes, are the links of each row. They are
   summed where they are found: what leaves a chunk is one row for each member and query, not for each link.
7. Links become components by alternating large-star and small-star steps on DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import NOT_BLANK, U64, gram_hashes, mix, words_of
from .common import bounded, discard, free_name, give_back, held_for, map_steps, materialize

#: Words of a shingle; similarity asked for, as a fraction.
SHINGLE, NUM, DEN = 5, 4, 5
#: One text in so many is looked at for common tokens; met so often there, a token is common. Of these the most common
#: are kept, 8 MiB of numbers: the order of tokens steers the work and loses no link, whichever tokens go last.
SAMPLED, COMMON, COMMON_KEPT = 64, 3, 1 << 20
#: Bins of a sketch; tokens of a chunk; bytes of a bucket of prefix tokens.
BINS, CHUNK_TOKENS, BUCKET_BYTES = 8, 1 << 18, 16 << 20
#: Members of a group up to which a query is compared with each by itself.
TAKEN_APART = 32
#: Queries that one task asks against a chunk; with more of them its members go to several tasks.
QUERIES = 8192
#: Files of a table up to which its rows are numbered by file and place: their paths go to the driver and to all executors.
FILES = 1 << 16
_NONE = np.zeros(0, U64)


def shingle_sets(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, and 128 bits of hash of its words in order."""
    w = words_of(column, NOT_BLANK)
    grams, first = gram_hashes(w, SHINGLE)
    sets = [np.unique(grams[first[i] : first[i + 1]]) for i in range(len(first) - 1)]
    at = np.arange(len(w.hash), dtype=U64) - np.repeat(w.first[:-1], np.diff(w.first)).astype(U64)
    keys = []
    with np.errstate(over="ignore"):
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            sums = np.zeros(len(w.hash) + 1, U64)
            np.cumsum(mix(w.hash ^ mix(at * U64(2) + U64(salt))), out=sums[1:])
            keys.append((sums[w.first[1:]] - sums[w.first[:-1]]).view(np.int64))
    return sets, keys[0], keys[1]


def prefix_of(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first tokens, in the order common ones last and else by hash, of which one is in every set with J >= NUM/DEN."""
    n = len(tokens)
    size = n - -(-NUM * n // DEN) + 1
    if n == 0 or not len(common):
        return tokens[: size if n else 0]
    is_common = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
    rare = tokens[~is_common][:size]
    return np.concatenate([rare, tokens[is_common][: size - len(rare)]]) if len(rare) < size else rare


def size_class(n: int) -> int:
    """Sizes that differ by a factor of up to 5/4 lie at most 5 classes apart."""
    return min(255, int(np.log(n) / (np.log(1.25) / 4))) if n else 0


def parity_of(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall on each bit, modulo 2: at least 1024 bits, about two for each token, 65536 at most.

    Two sets differ in at least as many tokens as their parities differ in bits.
    """
    bits = 1 << min(16, max(10, int(2 * len(tokens)).bit_length()))
    return np.packbits(np.bincount((tokens & U64(bits - 1)).astype(np.int64), minlength=bits) & 1)


def may_link(n: int, a: np.ndarray, m: int, b: np.ndarray) -> bool:
    """False only if sets of n and m tokens with these parities differ in more tokens than J >= NUM/DEN allows."""
    if len(a) < len(b):
        a, b = b, a
    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum()) * (DEN + NUM) <= (DEN - NUM) * (n + m)


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = (b.column(c).to_pylist() for c in ("n", "parity", "m", "other"))
        keep = [may_link(n, np.frombuffer(x, np.uint8), m, np.frombuffer(y, np.uint8)) for n, x, m, y in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("target")], names=["q", "target"]).filter(pa.array(keep, pa.bool_()))


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """The smallest token of each of BINS ranges of hashes."""
    at = np.searchsorted(tokens, np.arange(BINS, dtype=U64) << U64(61))
    ends = np.append(at[1:], len(tokens))
    return tokens[at[at < ends]]


def common_tokens(texts: DataFrame) -> np.ndarray:
    """Tokens that many texts hold, from one text in SAMPLED; at most COMMON_KEPT, the most common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sets, key, _ = shingle_sets(b.column("text"))
            fresh = [s for s, k in zip(sets, key.tolist(), strict=True) if not (k in seen or seen.add(k))]
            u, c = np.unique(np.concatenate(fresh) if fresh else _NONE, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["token", "n"])

    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text")
    top = drawn.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(COMMON_KEPT)
    return np.sort(top.toArrow().column("token").to_numpy().view(U64))


def _signatures(docs: DataFrame, common) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, h1, h2 = shingle_sets(batch.column("text"))
        some = common.value
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(h1), pa.array(h2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_sketch(s).view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([prefix_of(s, some).tobytes() for s in sets], pa.binary()), pa.array([parity_of(s).tobytes() for s in sets], pa.binary())],
            names=["row", "doc_id", "h1", "h2", "n", "sketch", "prefix", "parity"],
        )

    return map_steps(docs, kernel, "row long, doc_id long, h1 long, h2 long, n long, sketch array<long>, prefix binary, parity binary")


def _groups(reps: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """rep, centre: representatives that agree with a centre in at least half of their sketch; others are alone. And tables to discard.

    Counts and centres by sketch value are written before they are joined: a join of two tables read from files can
    be dealt anew where one value is very common.
    """
    s = reps.select(F.col("row").alias("rep"), F.size("sketch").alias("bins"), F.explode("sketch").alias("v"))
    counts = materialize(s.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "join-counts")
    met = materialize(s.join(counts, "v"), "join-sketches")
    # The most central of a bucket is the one whose whole sketch is most common.
    score = met.groupBy("rep").agg(F.sum("c").alias("score"))
    centres = materialize(met.join(score, "rep").groupBy("v").agg(F.max(F.struct("score", F.col("rep").alias("centre"))).alias("m")), "join-centres")
    picks = met.join(centres, "v").groupBy("rep", "bins", "m").agg(F.count(F.lit(1)).alias("agree")).where(F.col("agree") * 2 >= F.col("bins"))
    best = picks.groupBy("rep").agg(F.max(F.struct("agree", "m.score", "m.centre")).alias("b")).select("rep", F.col("b.centre").alias("centre")).where("rep <> centre")
    best = materialize(best, "join-picks")
    centre = best.select(F.col("centre").alias("rep")).distinct()
    return best.join(centre, "rep", "left_anti").unionAll(centre.select("rep", F.col("rep").alias("centre"))), [counts, met, centres, best]


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted's rows (with rep) and the shingle sets of their texts."""
    has = docs.select(F.col("row").alias("rep"), "text").join(bounded(wanted), "rep")
    extra = [c for c in wanted.columns if c != "rep"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, _, _ = shingle_sets(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary()), *(batch.column(c) for c in extra)], names=["rep", "tokens", *extra])

    kinds = dict(wanted.dtypes)
    return map_steps(has, kernel, ", ".join(["rep long", "tokens binary", *(f"{c} {kinds[c]}" for c in extra)]))


class Chunk:
    """Members' sets, and an index from each token of their union to the members that hold it."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else _NONE
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        head = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
        self.union, self.first, self.count = tokens[head], head, np.diff(np.append(head, len(tokens)))
        self.least = int(self.sizes.min(initial=1))

    def linked(self, tokens: np.ndarray) -> np.ndarray:
        """Places of the members whose Jaccard similarity with the tokens is at least NUM/DEN."""
        n = len(tokens)
        if not n or not len(self.union):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        # J >= NUM/DEN means an overlap of at least NUM (n + m) / (NUM + DEN).
        if len(at) * (NUM + DEN) < NUM * (n + self.least):
            return np.zeros(0, np.int64)
        c = self.count[at]
        flat = np.repeat(self.first[at] - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(c.sum())
        both = np.bincount(self.owner[flat], minlength=len(self.ids))
        return np.flatnonzero(DEN * both >= NUM * (n + self.sizes - both))


class Forest:
    """Members of a chunk joined to trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, others: list[int]) -> None:
        for j in {self.root(j) for j in others}:
            self.parent[j] = self.root(i)

    def least(self, ids: list[int]) -> list[int]:
        """The smallest id in each member's tree."""
        roots = [self.root(i) for i in range(len(ids))]
        best: dict[int, int] = {}
        for r, x in zip(roots, ids, strict=True):
            best[r] = min(x, best.get(r, x))
        return [best[r] for r in roots]


def _found(rep: list[int], root: list[int], links: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rep, root, links)], names=["rep", "root", "links"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per member of a chunk: rep, root (one member of those connected inside the chunk), links (rows of other members linked with it)."""
    held_for(None)
    chunk, ids, weights, sets = None, [], [], []

    def close() -> pa.RecordBatch:
        c, forest, w = Chunk(ids, sets), Forest(len(ids)), np.array(weights, np.int64)
        links = []
        for i, x in enumerate(sets):
            mates = c.linked(x)
            links.append(int(w[mates].sum() - w[i]))
            forest.join(i, mates[mates < i].tolist())
        return _found(ids, forest.least(ids), links)

    for b in batches:
        for at, rep, weight, tokens in zip(*(b.column(c).to_pylist() for c in ("chunk", "rep", "weight", "tokens")), strict=True):
            if at != chunk:
                if ids:
                    yield close()
                chunk, ids, weights, sets = at, [], [], []
            ids.append(rep)
            weights.append(weight)
            sets.append(np.frombuffer(tokens, U64))
    if ids:
        yield close()
    give_back()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (side 1) asked against members (side 0) of the same chunk and asker: per query and per member with links, rep, root (linked with it), links (rows)."""
    held_for(None)
    key, ids, weights, sets, index = None, [], [], [], None
    out: tuple[list[int], list[int], list[int]] = ([], [], [])

    def close() -> None:
        if index:
            some, root = np.flatnonzero(links).tolist(), forest.least(ids)
            for column, more in zip(out, ([ids[i] for i in some], [root[i] for i in some], links[some].tolist()), strict=True):
                column.extend(more)

    for b in batches:
        for *at, side, rep, weight, tokens in zip(*(b.column(c).to_pylist() for c in ("chunk", "asker", "side", "rep", "weight", "tokens")), strict=True):
            if at != key:
                close()
                key, ids, weights, sets, index = at, [], [], [], None
            if side == 0:
                ids.append(rep)
                weights.append(weight)
                sets.append(np.frombuffer(tokens, U64))
                continue
            if index is None:
                index, forest, w, links = Chunk(ids, sets), Forest(len(ids)), np.array(weights, np.int64), np.zeros(len(ids), np.int64)
            mates = index.linked(np.frombuffer(tokens, U64))
            if len(mates):
                links[mates] += weight
                forest.join(int(mates[0]), mates[1:].tolist())
                for column, x in zip(out, (rep, ids[mates[0]], int(w[mates].sum())), strict=True):
                    column.append(x)
            if len(out[0]) > 10_000:
                yield _found(*out)
                out = ([], [], [])
    close()
    if out[0]:
        yield _found(*out)
    give_back()


#: Share of a set that must stand behind a token, by how many classes (-6 to 6) the other set is larger, at least.
_REST = NUM / (NUM + DEN) * (1 + np.exp((np.arange(-6, 7) - 1) * np.log(1.25) / 4)) - 1e-9
#: Marks the number of a group of several, and of one too large to be taken apart; a representative alone is its own group.
_MANY, _LARGE = U64(1 << 63), U64(1 << 62)


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> U64(40)) % U64(buckets)).astype(np.int64)


def _counted(buckets: int):
    """Prefix tokens of a partition by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for(None)
        n = np.zeros(buckets, np.int64)
        for b in batches:
            n += np.bincount(_bucket(np.frombuffer(b"".join(b.column("prefix").to_pylist()), U64), buckets), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    return run


def _pack(buckets: int, apart: int):
    """Prefix tokens by bucket of their hash, many in a row: token, place and size class; representative; group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefixes = [np.frombuffer(x, U64) for x in b.column("prefix").to_pylist()]
            sizes = [len(x) for x in prefixes]
            if not sum(sizes):
                continue
            tokens = np.concatenate(prefixes)
            classes = np.repeat(np.array([size_class(n) for n in b.column("n").to_pylist()], U64), sizes)
            # How much of its set stands before a token, in 255ths rounded down.
            n = np.repeat(b.column("n").to_numpy(), sizes)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = (place * 255 // n).astype(U64)
            rep = np.repeat(b.column("row").to_numpy().view(U64), sizes)
            centre, row = b.column("centre").fill_null(-1).to_numpy(), b.column("row").to_numpy()
            mark = np.where(b.column("size").fill_null(0).to_numpy() > apart, _MANY | _LARGE, _MANY)
            group = np.repeat(np.where(centre >= 0, centre.astype(np.int64).view(U64) | mark, row.view(U64)), sizes)
            bucket = _bucket(tokens, buckets)
            order = np.argsort(bucket, kind="stable")
            entry = np.stack([(tokens & ~U64(0xFFFF)) | place << U64(8) | classes, rep, group])[:, order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = [i for i in range(buckets) if cuts[i + 1] > cuts[i]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([entry[r, cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()) for r in range(3))], names=["bucket", "entry", "reps", "groups"])

    return run


def _distinct_pairs(found: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(found)
    if len(pairs):
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]
    return pairs


def candidates(entry: np.ndarray, rep: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct queries and the groups they have to be asked against, from the prefix tokens of one bucket.

    A token's entries in one group are looked at as a whole first: what the group's members hold between them bounds
    what one of them can. So the work follows the groups that share a token, not the pairs of their members.
    """
    order = np.lexsort((group, entry >> U64(16)))
    entry, rep, group = entry[order], rep[order], group[order]
    if not len(entry):
        return _NONE, _NONE
    token, size, left = entry >> U64(16), (entry & U64(255)).astype(np.int64), 1 - ((entry >> U64(8)) & U64(255)).astype(float) / 255
    # Parts: entries of one token and group. least and most: their size classes; room: the largest share of a set from the token on.
    at = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])))
    to = np.append(at[1:], len(entry))
    least, most, room = np.minimum.reduceat(size, at), np.maximum.reduceat(size, at), np.maximum.reduceat(left, at)
    head = np.flatnonzero(np.append(True, token[at][1:] != token[at][:-1]))
    tail = np.append(head[1:], len(at))
    several = tail - head > 1
    head, tail = head[several], tail[several]
    found = [np.zeros((0, 2), U64)]
    waiting = 0

    def may_meet(lo: np.ndarray, hi: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        # Sets of classes lo to hi with a share x from the token on, and those of part j. If this is the first token that
        # two sets share, all others stand behind it in both, and these must be NUM / (NUM + DEN) of both sizes
        # together. The first shared one is met too, so others may be passed over. Class 255 has no upper end.
        near = (least[j] - hi <= 5) & (lo - most[j] <= 5)
        open_ = (hi == 255) | (most[j] == 255)
        return near & (open_ | (x >= _REST[(least[j] - hi).clip(-6, 6) + 6]) & (room[j] >= _REST[(lo - most[j]).clip(-6, 6) + 6]))

    # Parts at distance 1, 2, ... within a token's run; runs that are too short for a distance drop out.
    first = np.concatenate([np.arange(h, t) for h, t in zip(head, tail, strict=True)]) if len(head) else np.zeros(0, np.int64)
    end = np.repeat(tail, tail - head)
    step = 1
    while len(first):
        keep = first + step < end
        first, end = first[keep], end[keep]
        i, j = first, first + step
        good = may_meet(least[i], most[i], room[i], j)
        i, j = i[good], j[good]
        # Groups are sorted, those of one representative first: one alone asks a group, and of two of a kind the one with the smaller number asks.
        for k in range(0, len(i), 1 << 16):
            n = to[i[k : k + (1 << 16)]] - at[i[k : k + (1 << 16)]]
            member = np.repeat(at[i[k : k + (1 << 16)]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            asked = np.repeat(j[k : k + (1 << 16)], n)
            good = may_meet(size[member], size[member], left[member], asked)
            found.append(np.stack([rep[member[good]], group[at[asked[good]]]], axis=1))
            waiting += int(good.sum())
            if waiting > 2_000_000:
                found, waiting = [_distinct_pairs(found)], 0
        step += 1
    pairs = _distinct_pairs(found)
    return pairs[:, 0], pairs[:, 1]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of the one bucket, or pair of blocks of a large bucket, that a partition holds: q, target, kind (0 a representative, 1 a group, 2 a large one)."""
    held_for(None)
    cols: list[list[bytes]] = [[], [], []]
    for b in batches:
        for c, name in zip(cols, ("entry", "reps", "groups"), strict=True):
            c += b.column(name).to_pylist()
    q, g = candidates(*(np.frombuffer(b"".join(c), U64) for c in cols))
    kind = ((g & _MANY) > 0).astype(np.int32) + ((g & _LARGE) > 0)
    for i in range(0, len(q), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(q[s].view(np.int64)), pa.array((g[s] & ~(_MANY | _LARGE)).view(np.int64)), pa.array(kind[s], pa.int32())], names=["q", "target", "kind"])
    give_back()


def _dealt(packed: DataFrame, buckets: int, sizes: dict[int, int]) -> DataFrame:
    """packed's rows, one partition for each bucket. A bucket of several times the intended size (sizes: entries of such) is cut into blocks, any two of which meet in a partition of their own."""
    if not sizes:
        return packed.repartitionById(buckets, F.col("bucket"))
    rows, first = [], buckets
    for bucket, n in sorted(sizes.items()):
        k = -(-n * 24 // BUCKET_BYTES)
        rows.append((bucket, k, first))
        first += k * k
    large = F.broadcast(packed.sparkSession.createDataFrame(rows, "bucket int, blocks int, first int"))  # a row for each 64 MB of prefixes at most
    d = packed.join(large, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("reps"), F.col("blocks")).cast("int"))
    d = d.withColumn("mate", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    pair = F.col("first") + F.least("block", "mate") * F.col("blocks") + F.greatest("block", "mate")
    return d.withColumn("task", F.coalesce(pair, "bucket")).repartitionById(first, F.col("task"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable along edges (a, b), by large-star and small-star steps; only nodes with an edge.

    Where a node has far more edges than a partition holds on average, smallest neighbours are written before they are
    joined: a join of tables read from files can be dealt anew.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = lambda e: tuple(e.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).agg(F.sum("n"), F.sum("h"), F.max("n")).first())
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    after = state(e)
    while True:
        before, written = after, [e]

        def aside(df: DataFrame) -> DataFrame:
            if before[0] and before[2] * parts > 2 * before[0]:
                df = materialize(df, "star-least")
                written.append(df)  # noqa: B023
            return df

        # Large star: neighbours larger than a node go to the node's smallest neighbour or itself.
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = aside(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star-large")
        # Small star: a node and its smaller neighbours go to the smallest of these.
        lower = aside(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lower.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "star")
        discard(*written, large)
        after = state(e)
        if after == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = materialize(nodes.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "star-roots")
    discard(e)
    return out


def placed(docs: DataFrame, name: str) -> DataFrame | None:
    """docs with the number of each row: rows of the files before its own, by path, and its place there. None if docs is no plain table of Parquet files."""
    kind = lambda x: x.getClass().getSimpleName()
    plan = docs._jdf.queryExecution().analyzed()
    # Above joins, unions and the like a place may stand for several rows.
    if kind(plan) != "LogicalRelation" or kind(plan.relation()) != "HadoopFsRelation" or kind(plan.relation().fileFormat()) != "ParquetFileFormat" or len(docs._jdf.inputFiles()) > FILES:
        return None
    path, at, start = (free_name(x, [*docs.columns, name]) for x in ("file_path", "row_index", "file_start"))
    meta = docs.metadataColumn("_metadata")
    d = docs.withColumns({path: meta["file_path"], at: meta["row_index"]})
    starts, n = [], 0
    for f, rows, last in sorted(d.groupBy(path).agg(F.count(F.lit(1)), F.max(at)).collect()):
        if rows != last + 1:  # a file that is read twice
            return None
        starts.append((f, n))
        n += rows
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, f"{path} string, {start} long"))
    return d.join(starts, path).withColumn(name, F.col(start) + F.col(at)).drop(path, at, start)


def numbered(docs: DataFrame, name: str = "row", columns: list[str] | None = None) -> DataFrame:
    """docs with a number for each row: read again, a row has the same number whatever executors there are.

    A table read from Parquet files is numbered by their places and not written again; these files have to stay until
    what follows from the numbers has been read. Any other is written, only columns of it if these are given.
    """
    found = placed(docs, name)
    if found is not None:
        return found
    return materialize((docs.select(*columns) if columns else docs).withColumn(name, F.monotonically_increasing_id()), "join-rows")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row: row, doc_id, n_shingles, n_links, component_row, component_id.

    Words are runs of non-blank characters with A-Z lower-cased; a row's set holds its distinct 5-word shingles, with
    fewer words its whole sequence as one. Rows link when 100 * intersection >= 80 * union. n_links is the number of
    other rows that a row is linked with, copies of it included. component_id is the smallest
    doc_id among rows reachable by links; component_row, the same for all these rows and no others, numbers components.
    Null and blank texts have empty sets and are linked with nothing. Null ids are passed over for component_id, which
    is null only where all are. Rows repeated under one id are linked by their texts like any others. An empty table
    gives no rows; further columns are not looked at. row is row_col, a distinct number for each row of a table read
    from files; without it rows are numbered first.
    """
    spark = docs.sparkSession
    used: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        used.append(materialize(df, f"join-{name}"))
        return used[-1]

    if not row_col:
        row_col = free_name("row", docs.columns)
        docs = numbered(docs, row_col, [id_col, text_col])
        used += [docs] if "_scratch" in vars(docs) else []
    d = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    common = spark.sparkContext.broadcast(common_tokens(d))
    sig = materialize(_signatures(d, common), "join-signatures")
    classes = keep(sig.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("weight")), "classes")
    is_rep = bounded(classes.select(F.col("rep").alias("row")))
    reps = sig.where("n > 0").join(is_rep, "row", "left_semi")

    found, more = _groups(reps)
    used += more
    groups = keep(found.join(classes.select("rep", "n"), "rep"), "groups")
    sums = keep(groups.groupBy("centre").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.sum("n") / CHUNK_TOKENS).cast("int").alias("parts")), "sums")
    placed = groups.join(sums, "centre").select("rep", "centre", "size", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"))
    cut = sums.where("parts > 1").count()
    # A chunk is called by one of its members: an uncut group's by the centre, others by their least.
    if cut:
        placed = keep(placed, "parts")
        heads = placed.where("parts > 1").groupBy("centre", "part").agg(F.min("rep").alias("chunk"))
        of_cut = placed.where("parts > 1").join(heads, ["centre", "part"]).select("rep", "centre", "size", "chunk")
        placed = placed.where("parts = 1").select("rep", "centre", "size", F.col("centre").alias("chunk")).unionAll(of_cut.select("rep", "centre", "size", "chunk"))
    else:
        placed = placed.select("rep", "centre", "size", F.col("centre").alias("chunk"))
    placed = keep(placed, "chunks")
    weights = classes.select("rep", "weight")
    sets = _texts_of(d, placed.select("rep", "chunk").join(weights, "rep"))
    within = keep(sets.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_within, "rep long, root long, links long"), "within")

    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (DEN - NUM) / DEN * 24 / BUCKET_BYTES))
    entries = reps.select("prefix").mapInArrow(_counted(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") * 24 > 4 * BUCKET_BYTES)
    tagged = reps.select("row", "n", "prefix").join(bounded(placed.select(F.col("rep").alias("row"), "centre", "size")), "row", "left")
    packed = tagged.mapInArrow(_pack(buckets, TAKEN_APART), "bucket int, entry binary, reps binary, groups binary")
    met = _dealt(packed, buckets, {r.bucket: r.n for r in entries.collect()}).mapInArrow(_meet, "q long, target long, kind int").distinct()
    met = keep(met, "candidates")
    # Small groups are taken apart into their members, large ones are asked as a whole. Either way no link is lost.
    apart = met.where("kind = 1").select("q", F.col("target").alias("centre")).join(placed.select("centre", F.col("rep").alias("target")), "centre").select("q", "target")
    # Parities tell most pairs apart that only share a passage.
    pairs = keep(met.where("kind = 0").select("q", "target").unionAll(apart).where("q <> target"), "close")
    ends = keep(pairs.select(F.col("q").alias("row")).unionAll(pairs.select(F.col("target").alias("row"))).distinct(), "ends")
    parity = sig.select("row", "n", "parity").join(bounded(ends), "row", "left_semi")
    pairs = pairs.join(parity.withColumnRenamed("row", "q"), "q").join(parity.select(F.col("row").alias("target"), F.col("n").alias("m"), F.col("parity").alias("other")), "target")
    # Askers below 0 keep chunks of one member (even), chunks of groups (odd) and pairs of chunks apart.
    alone = keep(pairs.select("q", "target", "n", "parity", "m", "other").mapInArrow(_may_link, "q long, target long"), "pairs").select("q", F.col("target").alias("chunk"), F.lit(-2).cast("long").alias("asker"))
    grouped = met.where("kind = 2").select("q", F.col("target").alias("centre"))
    if cut:
        chunks = keep(placed.select("centre", "chunk").distinct(), "names")
        grouped = grouped.join(chunks, "centre")
    else:
        grouped = grouped.withColumn("chunk", F.col("centre"))
    asked = alone.unionAll(grouped.select("q", "chunk", F.lit(-1).cast("long").alias("asker")))
    # Chunks with very many queries have several askers, each with a share of the queries.
    shares = keep(asked.groupBy("chunk", "asker").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("shares")).where("shares > 1"), "shares")
    asked = asked.join(bounded(shares), ["chunk", "asker"], "left")
    asked = asked.select("q", "chunk", F.col("asker").alias("kind"), (F.col("asker") - 2 * F.pmod(F.xxhash64("q"), F.coalesce("shares", F.lit(1)))).alias("asker"))
    opened = asked.select("chunk", "kind", "asker").distinct()
    inside = placed.select("rep", "chunk").join(opened.where("kind = -1"), "chunk").select("chunk", "asker", "rep").unionAll(opened.where("kind = -2").select("chunk", "asker", F.col("chunk").alias("rep")))
    sides = inside.select("chunk", "asker", F.lit(0).alias("side"), "rep").unionAll(asked.select("chunk", "asker", F.lit(1).alias("side"), F.col("q").alias("rep")))
    if cut:
        # Of two chunks of a cut group one is asked with all members of the other.
        two = chunks.join(bounded(keep(sums.where("parts > 1").select("centre"), "cut")), "centre", "left_semi")
        two = two.join(two.withColumnRenamed("chunk", "asker"), "centre").where("asker < chunk").select("chunk", "asker")
        members = placed.select("rep", "chunk")
        sides = sides.unionAll(two.join(members, "chunk").select("chunk", "asker", F.lit(0).alias("side"), "rep"))
        sides = sides.unionAll(two.join(members.withColumnRenamed("chunk", "asker"), "asker").select("chunk", "asker", F.lit(1).alias("side"), "rep"))
    sides = keep(sides, "sides")
    texts = _texts_of(d, sides.select("rep").distinct().join(weights, "rep"))
    across = texts.join(sides, "rep").select("chunk", "asker", "side", "rep", "weight", "tokens").repartition("chunk", "asker").sortWithinPartitions("chunk", "asker", "side")
    found = within.unionAll(keep(across.mapInArrow(_asked, "rep long, root long, links long"), "across"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))

    named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    used.append(named)
    least = keep(named.join(classes.select(F.col("rep").alias("node"), "least"), "node"), "named")
    lowest = keep(least.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    of = least.join(lowest, "root").select(F.col("node").alias("rep"), "root", "component_id")
    of = classes.select("h1", "h2", "rep", "least", "weight").join(of, "rep", "left").join(counts, "rep", "left")
    of = of.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_row"), F.coalesce("component_id", "least").alias("component_id"))
    of = materialize(of, "join-components")
    discard(*used)
    rows = sig.select("row", "doc_id", "h1", "h2", "n")
    some = rows.where("n > 0").join(of, ["h1", "h2"]).select("row", "doc_id", F.col("n").alias("n_shingles"), "n_links", "component_row", "component_id")
    return some.unionAll(rows.where("n = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"), F.col("row").alias("component_row"), F.col("doc_id").alias("component_id")))


def digest(joined: DataFrame) -> DataFrame:
    return joined.select("doc_id", "n_shingles", "n_links", "component_id")
