"""Similarity join of documents on sets of word shingles, exact, with count-vector R-trees.

1. Equal sets are one node (a 128-bit digest); a document is a node and a number of shingles.
2. A pair that is similar enough shares ``SHARED`` of the first n - ceil(t n) + ``SHARED`` shingles of both
   sets in any common order. Shingles that a bounded list of frequent ones holds come last in it. These
   prefixes go, packed per bucket, to reducers that find the nodes sharing a prefix shingle. Such a group is
   cut where sizes are too far apart, and each part goes to its home, the least node of it: groups of one
   family share a home, so that few tasks, not hundreds, meet the same pair. Two nodes that are alone in
   their groups count only if they share two of these (chance makes one), else a larger group has them.
3. In a home nodes are points: the counts of their shingles by hash group. A bulk-loaded R-tree, joined with
   itself, bounds the overlap of boxes, then of points, by the sum of the coordinates' minima. Members
   without a pair that survives leave their home; of the others the whole texts come along, compressed.
4. The tree of a home's rest gives its surviving pairs of different components, nearest first. They are
   verified on the texts, and linked ones are merged at once. A home puts out the links that connect its
   members, never more than these.
5. Components of all links give every document its component.

Prefix shingles of very many nodes are dealt over salted buckets. Homes of more than ``chunk`` shingles are
split into bands of size and chunks, each with the home's least node; only those that still hold several
components go on to pairs of chunks. No link between different sets is lost; equal sets never make pairs.

Null or empty texts, and texts without words, have an empty set and link with nothing; null identifiers
take part but never name a component while another identifier is there; equal identifiers and repeated rows
are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import batch_of, give_back, materialize, text_slices
from tracemill.llm.components import components
from tracemill.llm.shingles import digest, shingle_sets

NUMERATOR, DENOMINATOR = 75, 100
DIMENSIONS, FINEST = 64, 4096  # least and largest number of hash groups
SHARED = 3  # sets of one or two shingles have no other similar set; any other pair that is similar shares three
FREQUENT = 200_000  # bound of the list of frequent shingles
OFTEN = 4  # times that a shingle occurs among FLUSH ones to be listed
FLUSH = 2_000_000  # shingles that a task counts or packs at a time
BUCKET_BYTES = 25_000_000  # text per bucket of prefixes
HOT = 200_000  # rows with a shingle beyond which its nodes are dealt over salted buckets
CHUNK = 3_000_000  # shingles of a home's members in one task


def similar(overlap, n1, n2):
    """100 * intersection >= 75 * union."""
    return (NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (n1 + n2)


def prefix_length(n: int) -> int:
    return min(n, n - -(-NUMERATOR * n // DENOMINATOR) + SHARED)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _short(nodes) -> np.ndarray:
    """The first eight bytes of digests, as they stand for nodes while candidates are searched."""
    return np.frombuffer(b"".join(x[:8] for x in nodes), "<i8")


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("short", pa.int64()), ("counts", pa.binary()), ("z", pa.binary()), ("shingle", pa.int64()), ("seen", pa.int64())])


def _profile(batches):
    """A row per document, with its counts and text compressed, and rows of shingles that many documents of this task share."""
    held, count, z = [], 0, zstandard.ZstdCompressor(level=3)

    def frequent():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= OFTEN
        return batch_of(_PROFILE, [(None, None, None, None, None, None, s, c) for s, c in zip(values[often].view(np.int64).tolist(), counts[often].tolist())])

    for part in text_slices(batches, max_bytes=1 << 20):
        rows, texts = [], part.column("text").to_pylist()
        for doc_id, text, tokens in zip(part.column("doc_id").to_pylist(), texts, shingle_sets(texts)):
            node = digest(tokens)
            data = (z.compress(counts_of(tokens, groups_for(len(tokens))).tobytes()), z.compress(text.encode("utf-8", "surrogatepass"))) if len(tokens) else (None, None)
            rows.append((doc_id, len(tokens), node, int(_short([node])[0]), *data, None, 0))
            held.append(tokens)
            count += len(tokens)
        yield batch_of(_PROFILE, rows)
        if count >= FLUSH:
            yield frequent()
            held, count = [], 0
    if held:
        yield frequent()
    held = []
    give_back()


_POSTINGS = pa.schema([("bucket", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("shingles", pa.binary()), ("owner", pa.binary())])


def _marks(shingles: np.ndarray) -> np.ndarray:
    """32 bits of shingles. Two that agree in them share a group: of three shared shingles two are left then."""
    with np.errstate(over="ignore"):
        return (shingles * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def _postings(frequent, buckets: int):
    """Prefixes of the distinct sets of this task, packed by bucket."""

    def pack(nodes, sizes, prefixes):
        _, _, hot, salts = frequent.value
        node, size = _short(nodes), np.asarray(sizes, np.int32)
        shingle = np.concatenate(prefixes)
        owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), [len(p) for p in prefixes])
        bucket = (shingle >> np.uint64(20)) % np.uint64(buckets)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, shingle), len(hot) - 1)
            of = np.flatnonzero(hot[at] == shingle)
            salt = (node[owner[of]].view(np.uint64) >> np.uint64(11)) % salts[at[of]]
            bucket[of] = (bucket[of] + salt) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])).tolist() if len(order) else []
        rows = []
        for a, b in zip(first, [*first[1:], len(order)]):
            mine = order[a:b]
            used, place = np.unique(owner[mine], return_inverse=True)
            rows.append((int(bucket[mine[0]]), node[used].tobytes(), size[used].tobytes(), _marks(shingle[mine]).tobytes(), place.astype(np.uint16 if len(used) < 65_536 else np.uint32).tobytes()))
        return batch_of(_POSTINGS, rows)

    def run(batches):
        often, level, _, _ = frequent.value
        nodes, sizes, prefixes, seen, count = [], [], [], set(), 0
        for part in text_slices(batches, max_bytes=1 << 20):
            for tokens in shingle_sets(part.column("text").to_pylist()):
                n = len(tokens)
                if not n or (node := digest(tokens)) in seen:
                    continue
                seen.add(node)
                p = prefix_length(n)
                if len(often):
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    rank = np.where(often[at] == tokens, level[at], 0)
                    if rank.any():
                        tokens = tokens[np.argsort(rank, kind="stable")]
                nodes.append(node)
                sizes.append(n)
                prefixes.append(tokens[:p])
                count += p
            if count >= FLUSH // 4:
                yield pack(nodes, sizes, prefixes)
                nodes, sizes, prefixes, seen, count = [], [], [], set(), 0
        if nodes:
            yield pack(nodes, sizes, prefixes)
        nodes, sizes, prefixes, seen = [], [], [], set()
        give_back()

    return run


_GROUPS = pa.schema([("task", pa.int64()), ("hot", pa.int64()), ("least", pa.int64()), ("homes", pa.binary()), ("shorts", pa.binary()), ("sizes", pa.binary()), ("weights", pa.binary())])


def _groups(frequent, tasks: int):
    """Of one bucket: the distinct (home, member) of groups of two or more, packed by the task that sums them up.

    A weight is the number of groups of two, or 2 if another group has the member. Groups of hot shingles
    come by themselves, with their least node here; their task is that of the members until the home is known.
    """

    def reduce(table: pa.Table) -> pa.Table:
        nodes, sizes, marks = [], [], []
        for row in table.to_pylist():
            mark = np.frombuffer(row["shingles"], np.uint32)
            owner = np.frombuffer(row["owner"], np.uint16 if len(row["owner"]) == 2 * len(mark) else np.uint32)
            nodes.append(np.frombuffer(row["nodes"], np.int64)[owner])
            sizes.append(np.frombuffer(row["sizes"], np.int32)[owner])
            marks.append(mark)
        node, size, mark = np.concatenate(nodes), np.concatenate(sizes), np.concatenate(marks)
        del nodes, sizes, marks
        order = np.lexsort((node, size, mark))
        node, size, mark = node[order], size[order], mark[order]
        keep = np.concatenate([[True], (mark[1:] != mark[:-1]) | (node[1:] != node[:-1])])
        node, size, mark = node[keep], size[keep], mark[keep]
        hot = np.isin(mark, _marks(frequent.value[2]))
        far = NUMERATOR * size[1:].astype(np.int64) > DENOMINATOR * size[:-1].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (far & ~hot[1:])]))
        members = np.diff(np.concatenate([first, [len(mark)]]))
        home, members = np.repeat(np.minimum.reduceat(node, first), members), np.repeat(members, members)
        take = (members > 1) | hot
        weight, mark = np.where(hot | (members > 2), 2, 1)[take], np.where(hot, mark.astype(np.int64), -1)[take]
        home, node, size = home[take], node[take], size[take]
        task = np.where(mark < 0, home % tasks, node % tasks)
        order = np.lexsort((node, home, task, mark))
        home, node, size, mark, weight, task = home[order], node[order], size[order], mark[order], weight[order], task[order]
        new = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (node[1:] != node[:-1]) | (mark[1:] != mark[:-1])])[: len(home)])
        weight = np.minimum(np.add.reduceat(weight, new), 2).astype(np.uint8) if len(new) else weight
        home, node, size, mark, task = home[new], node[new], size[new], mark[new], task[new]
        cuts = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (task[1:] != task[:-1])])[: len(home)]).tolist()
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(home)]):
            one = (int(mark[a]), int(home[a])) if mark[a] >= 0 else (None, None)
            rows.append((int(task[a]), *one, home[a:b].tobytes(), node[a:b].tobytes(), size[a:b].tobytes(), weight[a:b].tobytes()))
        return pa.Table.from_batches([batch_of(_GROUPS, rows)])

    return reduce


def _members_of(table: pa.Table) -> pa.Table:
    """Distinct (home, short, size) of one task whose weights come to two or more."""
    parts: list[tuple] = []
    for row in table.to_pylist():
        home = np.frombuffer(row["homes"], np.int64)
        parts.append((np.full_like(home, row["least"]) if row["least"] is not None else home, np.frombuffer(row["shorts"], np.int64), np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["weights"], np.uint8)))
    home, node, size, weight = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((size, node, home))
    home, node, size, weight = home[order], node[order], size[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (node[1:] != node[:-1]) | (size[1:] != size[:-1])]))
    new = new[np.add.reduceat(weight.astype(np.int64), new) > 1]
    return pa.table({"home": home[new], "short": node[new], "size": size[new]})


def _homes(docs: DataFrame, plain: DataFrame, profile: DataFrame) -> DataFrame:
    """Distinct rows (home, short, size): nodes that may be similar share a home."""
    spark = docs.sparkSession
    often = profile.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "shingle").limit(FREQUENT).collect()
    ranked = sorted((r.shingle & (2**64 - 1), int(math.log2(r.seen)), r.seen) for r in often)
    hot = [(x[0], -(-x[2] // HOT)) for x in ranked if x[2] > HOT]
    column = lambda rows, i, kind: np.asarray([x[i] for x in rows], kind)
    frequent = spark.sparkContext.broadcast((column(ranked, 0, np.uint64), column(ranked, 1, np.int8), column(hot, 0, np.uint64), column(hot, 1, np.uint64)))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // BUCKET_BYTES) + 1)
    packed = plain.select("text").mapInArrow(_postings(frequent, buckets), "bucket int, nodes binary, sizes binary, shingles binary, owner binary")
    groups = packed.groupBy("bucket").applyInArrow(_groups(frequent, buckets), "task long, hot long, least long, homes binary, shorts binary, sizes binary, weights binary")
    if hot:
        groups = materialize(groups, "groups")
        least = groups.where("hot is not null").groupBy("hot").agg(F.min("least").alias("all_least"))
        groups = groups.join(F.broadcast(least), "hot", "left").withColumn("least", F.col("all_least"))  # a row for each hot shingle, FREQUENT at most
        groups = groups.withColumn("task", F.when(F.col("least").isNull(), F.col("task")).otherwise(F.pmod(F.pmod("least", F.lit(buckets)) + F.col("task"), F.lit(buckets))))
    return groups.select("task", "least", "homes", "shorts", "sizes", "weights").groupBy("task").applyInArrow(_members_of, "home long, short long, size int")


class CountTree:
    """An R-tree over count vectors, bulk-loaded by size and then by coordinates, joined with itself.

    ``order`` has the points leaf by leaf, so that every box is a range of it.
    """

    LEAF, FANOUT = 32, 8

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        def tile(rows: np.ndarray, axis: int) -> list[np.ndarray]:
            if len(rows) <= self.LEAF:
                return [rows]
            key = sizes[rows] if axis < 0 else points[rows, axis]
            rows = rows[np.argsort(key, kind="stable")]
            half = len(rows) // 2
            spread = int(points[rows[:: max(1, len(rows) // 512)]].var(0).argmax())
            return tile(rows[:half], spread) + tile(rows[half:], spread)

        leaves = tile(np.arange(len(sizes)), -1) if len(sizes) else []
        self.order = np.concatenate(leaves) if leaves else np.empty(0, np.int64)
        self.points, self.sizes = points[self.order], sizes[self.order].astype(np.int64)
        at, level = 0, []
        for leaf in leaves:
            end = at + len(leaf)
            level.append((self.points[at:end].max(0), int(self.sizes[at:end].min()), int(self.sizes[at:end].max()), (), at, end))
            at = end
        while len(level) > 1:
            level = [self._over(level[i : i + self.FANOUT]) for i in range(0, len(level), self.FANOUT)]
        self.root = level[0] if level else None

    @staticmethod
    def _over(children):
        return np.max([c[0] for c in children], 0), min(c[1] for c in children), max(c[2] for c in children), children, children[0][4], children[-1][5]

    @staticmethod
    def _may(x, y) -> bool:
        """No pair of the boxes is similar unless the minima of their upper corners add up to enough."""
        if NUMERATOR * max(x[1], y[1]) > DENOMINATOR * min(x[2], y[2]):
            return False
        return similar(int(np.minimum(x[0], y[0]).sum(dtype=np.int64)), x[1], y[1])

    def pairs(self, label: np.ndarray):
        """Arrays (i, j) of points of different labels whose bound is enough, likeliest first.

        Labels may change in place between two of them; boxes of one label are then passed over.
        """
        stack = [(self.root, self.root)] if self.root is not None else []
        while stack:
            x, y = stack.pop()
            own, other = label[self.order[x[4] : x[5]]], label[self.order[y[4] : y[5]]]
            if own[0] == other[0] and (own == own[0]).all() and (other == own[0]).all() or (x is not y and not self._may(x, y)):
                continue
            if not x[3] and not y[3]:
                bound = np.minimum(self.points[x[4] : x[5], None], self.points[None, y[4] : y[5]]).sum(2, dtype=np.int32).astype(np.int64)
                s, t = self.sizes[x[4] : x[5], None], self.sizes[None, y[4] : y[5]]
                good = similar(bound, s, t) & (own[:, None] != other[None])
                if x is y:
                    good &= np.arange(len(own))[:, None] < np.arange(len(own))[None]
                p, q = np.nonzero(good)
                if len(p):
                    best = np.argsort(-bound[p, q] / (s[p, 0] + t[0, q]), kind="stable")
                    yield self.order[x[4] + p[best]], self.order[y[4] + q[best]]
            elif x is y:
                kids = x[3]
                stack += [(a, b) for k, a in enumerate(kids) for b in kids[k + 1 :]]
                stack += [(a, a) for a in kids]  # nearest first
            elif not x[3] or (y[3] and len(y[3]) > len(x[3])):
                stack += [(x, b) for b in y[3]]
            else:
                stack += [(a, y) for a in x[3]]


def groups_for(n: int) -> int:
    """Number of hash groups for sets of about n shingles, one for two or three; a power of two, so that finer counts fold to coarser."""
    return min(FINEST, max(DIMENSIONS, 1 << (n // 3).bit_length()))


def counts_of(tokens: np.ndarray, groups: int) -> np.ndarray:
    """Shingles by hash group."""
    return np.minimum(np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups), 255 if groups < FINEST else 65_535).astype(np.uint8 if groups < FINEST else np.uint16)


def whole_counts(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """Shingles by hash group of each set, in the narrowest type that holds them all: their minima bound any overlap, however sizes mix."""
    counts = (np.bincount((x >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups) for x in sets)
    return np.stack([c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in counts])


def screen(sizes: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    """Which points have another one whose bound is enough.

    Points of one dimension are joined with each other and, folded, with the finer ones of at most a third
    more shingles. Points that are known to have one share a label, so that their boxes are passed over.
    """
    dimension = np.fromiter(map(len, counts), np.int64, len(counts))
    kept = np.zeros(len(counts), bool)
    for d in np.unique(dimension).tolist():
        rows = np.flatnonzero((dimension >= d) & (NUMERATOR * sizes <= DENOMINATOR * sizes[dimension == d].max()))
        if len(rows) < 2:
            continue
        points = np.stack([counts[i].reshape(-1, d).sum(0, dtype=np.uint16) for i in rows.tolist()])
        label = np.where(kept[rows], -1, np.arange(len(rows)))
        for i, j in CountTree(points, sizes[rows]).pairs(label):
            label[i] = label[j] = -1
        kept[rows[label < 0]] = True
    return kept


def _overlaps(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(many)
    starts = np.cumsum([0] + [len(x) for x in many[:-1]])
    return np.add.reduceat((one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat).astype(np.int64), starts)


def connect(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Verified links that join all linked sets of different labels; ``label`` is merged along, in place."""
    sizes, found = np.fromiter(map(len, sets), np.int64, len(sets)), []

    def try_row(i: int, others: np.ndarray) -> None:
        for at in range(0, len(others), 64):
            js = others[at : at + 64]
            js = js[label[js] != label[i]]
            if len(js):
                linked = js[similar(_overlaps(sets[i], [sets[j] for j in js.tolist()]), sizes[i], sizes[js])]
                for j in linked.tolist():
                    if label[j] != label[i]:
                        found.append((i, j))
                        label[label == label[j]] = label[i]

    for i, j in CountTree(whole_counts(sets, groups_for(8 * int(sizes.mean()))), sizes).pairs(label):
        while len(i):
            mine = i == i[0]
            try_row(int(i[0]), j[mine])
            rest = ~mine & (label[i] != label[j])
            i, j = i[rest], j[rest]
    return found


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _sets(zs: list[bytes]) -> list[np.ndarray]:
    z, out, texts, held = zstandard.ZstdDecompressor(), [], [], 0
    for data in zs:
        texts.append(z.decompress(data).decode("utf-8", "surrogatepass"))
        held += len(texts[-1])
        if held > 1 << 20:
            out += shingle_sets(texts)
            texts, held = [], 0
    return out + shingle_sets(texts)


def _meet(table: pa.Table) -> pa.Table:
    """Links that connect the members of every home in one task."""
    table = table.sort_by("home")
    home, nodes = table.column("home").to_numpy(), table.column("node").to_pylist()
    labels = [l or n for l, n in zip(table.column("label").to_pylist(), nodes)]
    number: dict[bytes, int] = {}
    label = np.fromiter((number.setdefault(x, len(number)) for x in labels), np.int64, len(labels))
    cuts = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), len(home)]
    z, links, at = table.column("z"), [], 0
    del table, labels
    while at + 1 < len(cuts):  # homes of about 4,000 members at a time
        end = at + 1
        while end + 1 < len(cuts) and cuts[end + 1] - cuts[at] <= 4_000:
            end += 1
        base, sets = cuts[at], _sets(z.slice(cuts[at], cuts[end] - cuts[at]).to_pylist())
        for a, b in zip(cuts[at:end], cuts[at + 1 : end + 1]):
            links += [(nodes[a + i], nodes[a + j]) for i, j in connect(sets[a - base : b - base], label[a:b].copy())]
        at = end
    return pa.table(batch_of(_LINKS, links).to_pydict(), schema=_LINKS)


def _survivors(table: pa.Table) -> pa.Table:
    """Of all homes in one task: the members with a pair whose bound is enough."""
    table = table.sort_by("home")
    home, size = table.column("home").to_numpy(), table.column("size").to_numpy().astype(np.int64)
    cuts, z, kept = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), len(home)], zstandard.ZstdDecompressor(), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        raw = map(z.decompress, table.column("counts").slice(a, b - a).to_pylist()) if b - a > 1 else ()
        counts = [np.frombuffer(x, np.uint16 if len(x) == 2 * FINEST else np.uint8) for x in raw]
        kept.append(screen(size[a:b], counts) if counts else np.zeros(b - a, bool))
    return table.filter(pa.array(np.concatenate(kept))).select(["home", "node", "row"])


def _verified(members: DataFrame, profile: DataFrame) -> DataFrame:
    """Links of rows (task, band, c1, c2, home, node, label, row) that meet in one task."""
    joined = members.join(profile.select("row", "z"), "row").select("task", "band", "c1", "c2", "home", "node", "label", "z")
    return joined.groupBy("task", "band", "c1", "c2").applyInArrow(_meet, "a binary, b binary")


def links(docs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every document, and verified links (a, b) that connect all linked nodes."""
    plain = _plain(docs)
    profile = plain.mapInArrow(_profile, "doc_id long, n long, node binary, short long, counts binary, z binary, shingle long, seen long")
    profile = materialize(profile.withColumn("row", F.monotonically_increasing_id()), "profile", compression="none")
    members = profile.where("shingle is null").select("doc_id", "n", "node")
    one = profile.where("n > 0").groupBy("node", "short").agg(F.min("row").alias("row"))
    homes = materialize(_homes(docs, plain, profile).join(one, "short"), "homes")

    big = materialize(homes.groupBy("home").agg(F.sum("size").alias("total")).where(F.col("total") > chunk), "big")
    tasks = 4 * max(int(homes.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0] // chunk) + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    task = F.pmod(F.xxhash64("home"), F.lit(tasks)).alias("task")
    screened = homes.join(big, "home", "left_anti").join(profile.select("row", "counts"), "row").select(task, "home", "node", "size", "row", "counts").groupBy("task").applyInArrow(_survivors, "home long, node binary, row long")
    zero, none = (F.lit(0).alias(c) for c in ("band", "c1", "c2")), F.lit(None).cast("binary").alias("label")
    small = screened.select(task, *zero, "home", "node", none, "row")
    if not big.limit(1).count():
        return members, materialize(_verified(small, profile), "links")

    band = F.floor(F.log(F.col("size").cast("double")) / math.log(DENOMINATOR / NUMERATOR) + 1e-9).cast("int")
    large = homes.join(big, "home").withColumn("band", F.explode(F.array(band, band + 1))).withColumn("parts", F.ceil(F.col("total") / chunk).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    star = F.when(F.col("short") == F.col("home"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("mine"))
    diagonal = large.withColumn("c1", F.explode(star)).select(F.col("home").alias("task"), "band", "c1", F.col("c1").alias("c2"), "home", "node", none, "row")
    first = materialize(_verified(small.union(diagonal), profile), "links")

    label = components(first, "a", "b")
    labelled = materialize(large.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    mixed = labelled.groupBy("home", "band").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2").select("home", "band")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("mine", j).alias("c1"), F.greatest("mine", j).alias("c2")))
    pairs = labelled.join(mixed, ["home", "band"], "left_semi").select("home", "band", "node", "label", "row", F.inline(F.filter(others, lambda m: m["c1"] < m["c2"])))
    second = materialize(_verified(pairs.select(F.col("home").alias("task"), "band", "c1", "c2", "home", "node", "label", "row"), profile), "links")
    return members, first.union(second)


def node_components(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (node, component_id) of nodes with shingles."""
    labels = components(found, "a", "b")
    nodes = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    whole = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    return whole.join(least, "label").select("node", "label", "component_id")


def join_components(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id)."""
    members, found = links(docs, chunk)
    named = node_components(members, found).select("node", "component_id")
    empty = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return members.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty)


def _with_nodes(batches):
    for part in text_slices(batches, max_bytes=1 << 20):
        sets = shingle_sets(part.column("text").to_pylist())
        yield part.append_column("_node", pa.array([digest(s) if len(s) else None for s in sets], pa.binary()))


def keep_one(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row of each component, of its least identifier; rows without words stay; all columns kept.

    Where identifiers are null or repeated, rows are told apart by their texts, and of equal rows one stays.
    """
    members, found = links(docs, chunk)
    named = node_components(members, found)
    rows, distinct = members.agg(F.count("*"), F.count_distinct("doc_id")).first()
    key = F.col("doc_id").cast("long")
    if rows == distinct:
        heads = named.select(F.col("component_id").alias("_kept")).union(members.where("n = 0").select("doc_id"))
        return docs.join(heads, key == F.col("_kept"), "left_semi")
    schema = docs.select("*", F.lit(None).cast("binary").alias("_node")).schema
    tagged = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_with_nodes, schema)
    labelled = tagged.join(named.select(F.col("node").alias("_node"), F.col("label").alias("_label"), F.col("component_id").alias("_head")), "_node", "left")
    heads = labelled.where(key.eqNullSafe(F.col("_head"))).dropDuplicates(["_label"])
    return labelled.where("_label is null").unionByName(heads).select(docs.columns)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under links of five-word shingle sets."""
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
