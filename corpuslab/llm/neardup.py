"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles, sketched by minwise tokens. Every tree sends a
document down the branches of a few of its tokens, chosen by hash so that about 1 / threshold
branches are followed at a node: documents of that similarity meet below each node with a
probability that does not fade with depth, and independent trees repeat the chance. Nodes
of few documents are compared exhaustively; larger ones below the roots link their members to a pivot first, a
member that agrees with the most others, and branch on where that leaves more than one component. Branches only find links early: what they leave in more than one
component is compared in blocks, all of the node, so a pair that meets below a root is never lost. Links are confirmed on full sets.
The candidates of blocks, of which most are no links, travel as parcels: full sets are brought to a parcel once for each of its members, not for each pair.

Equal sets are one class from the start, so copies cost nothing, and within a component
nothing more is compared, so a group of near copies takes about as many comparisons as members.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.graph import components
from corpuslab.llm.joins import listed
from corpuslab.llm.rows import ROWS_A_BATCH
from corpuslab.session import cut

TOKENS = 64  # minwise tokens of a sketch
BINS = 512  # ranges of hashes of which a sketch keeps four bits of the smallest member
TREES = 7
SMALL = 256  # documents of a node that are compared exhaustively
BLOCK = 4096  # documents of a side of a block of a large node
DEEPER = 3  # levels that large nodes go down at once to find links
VOTERS = 512  # members of a large node, about, among which its pivot is chosen
STRIP, PAIRS = 512, 8192  # first members, and candidate pairs, of a parcel that is confirmed in one piece
ITEMS = 1 << 20  # shingles of a parcel's sets, but for a parcel of one pair
U64 = np.uint64
SALTS = np.array([xxhash.xxh64_intdigest(b"", i) for i in range(4 * TOKENS)], U64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct hashed shingles, sorted. bytes.lower() and bytes.split() know ASCII alone:
    A-Z and the white space of the contract."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, U64)
    h = np.array(list(map(xxhash.xxh64_intdigest, words)), U64)
    n = min(size, len(h))
    many = len(h) - n + 1
    out = np.full(many, n, U64)
    for i in range(n):
        out = mixed(out ^ h[i : i + many])
    return np.unique(out)


def binned(own: np.ndarray) -> np.ndarray:
    """Of each range of hashes a number from 1 to 15 by the smallest member of the sorted set, or 0 for none; two a byte."""
    out = np.zeros(BINS, np.uint8)
    spot, first = np.unique(own >> U64(64 - (BINS.bit_length() - 1)), return_index=True)
    out[spot.astype(np.int64)] = own[first] % U64(15) + U64(1)
    return out[::2] << 4 | out[1::2]


def sketched(docs: DataFrame, size: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, class (digest of the set; null: empty set), tokens and bins (binary)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(column).alias("text_key"), F.col(column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        odd = SALTS[:TOKENS] | U64(1)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH // 4):
                batch = whole.slice(at, ROWS_A_BATCH // 4)
                n, names, tokens, bins = [], [], [], []
                for text in batch.column(2):
                    own = shingles(text.as_py(), size)
                    n.append(len(own))
                    names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    # Whole sets in blocks: as many rows of the product as fit in a few MB.
                    low = np.full(TOKENS, 2**64 - 1, U64)
                    for i in range(0, len(own), 4096):
                        low = np.minimum(low, (own[i : i + 4096, None] * odd).min(0))
                    tokens.append((low >> U64(32)).astype("<u4").tobytes() if len(own) else None)
                    bins.append(binned(own).tobytes() if len(own) else None)
                columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (names, tokens, bins)]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "class", "tokens", "bins"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, class binary, tokens binary, bins binary")


def chances(path: np.ndarray, threshold: float) -> np.ndarray:
    """Which tokens a node follows: each with chance 1 / (threshold * TOKENS), by a hash of node and token."""
    return mixed(path[:, None] ^ SALTS[2 * TOKENS : 3 * TOKENS]) < U64(int(2**64 / (threshold * TOKENS)))


def child(path: np.ndarray, at: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(path ^ SALTS[3 * TOKENS + at]) ^ token)


def root_slots(threshold: float) -> list[tuple[int, int]]:
    """(tree, token) of the branches below the roots, one at least of each tree. They are the same for all documents."""
    starts = SALTS[TOKENS : TOKENS + TREES]
    picked = chances(starts, threshold)
    picked[np.arange(TREES), mixed(starts[:, None] ^ SALTS[2 * TOKENS : 3 * TOKENS]).argmin(1)] = True
    return list(zip(*(x.tolist() for x in np.nonzero(picked))))


def rooted(rows: DataFrame, slots: list[tuple[int, int]]) -> DataFrame:
    """Nodes below the roots of rows (class, tokens), as (path, class, slot)."""
    trees, at = (np.array(x) for x in zip(*slots))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                tokens = matrix(batch.column("tokens"), "<u4").astype(U64)
                path = child(SALTS[TOKENS + trees][None, :], at[None, :], tokens[:, at])
                row = np.repeat(np.arange(len(tokens)), len(at))
                slot = np.tile(np.arange(len(at), dtype=np.int32), len(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(path.ravel().view(np.int64)), batch.column("class").take(pa.array(row)), pa.array(slot)], names=["path", "class", "slot"])

    return rows.select("class", "tokens").mapInArrow(run, "path long, class binary, slot int")


def branched(rows: DataFrame, threshold: float, levels: int) -> DataFrame:
    """Descendants of rows (path, class, tokens) some levels down, as (path, class, slot: none)."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, path = matrix(batch.column("tokens"), "<u4").astype(U64), np.asarray(batch.column("path")).view(U64)
            row = np.arange(len(tokens))
            for _ in range(levels):
                came, at = np.nonzero(chances(path, threshold))
                row = row[came]
                path = child(path[came], at, tokens[row, at])
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("class").take(pa.array(row)), pa.nulls(len(row), pa.int32())], names=["path", "class", "slot"])

    return rows.select("path", "class", "tokens").mapInArrow(run, "path long, class binary, slot int")


def populated(rows: DataFrame) -> DataFrame:
    """(path, size, slot) of the nodes of two classes and more, of nodes with the same members the first."""
    sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("class")).alias("members"), F.min("slot").alias("slot")).where("size > 1")
    first = F.min(F.struct("slot", "path")).alias("first")
    return sizes.groupBy("size", "members").agg(first).select("first.path", "size", "first.slot")


def slim(classes: DataFrame, slots: list[tuple[int, int]]) -> DataFrame:
    """What nodes need of the classes: class, n, low (a byte of each token), roots (the tokens of the root slots), bins."""
    at = np.array([i for _, i in slots])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                tokens = matrix(batch.column("tokens"), "<u4")
                low, roots = ([row.tobytes() for row in x] for x in ((tokens & 255).astype(np.uint8), np.ascontiguousarray(tokens[:, at])))
                yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("n_shingles"), pa.array(low, pa.binary()), pa.array(roots, pa.binary()), batch.column("bins")], names=["class", "n", "low", "roots", "bins"])

    return classes.select("class", "n_shingles", "tokens", "bins").mapInArrow(run, "class binary, n long, low binary, roots binary, bins binary")


def voted(rows: DataFrame) -> DataFrame:
    """(path, class) of one pivot of each gathered group (path, voters: class, low): the voter that
    agrees most often with what most voters have."""
    def run(batches):
        for batch in batches:
            lists = batch.column("voters")
            members = lists.flatten()
            if not len(members):
                continue
            low, ends = matrix(members.field("low"), np.uint8), np.cumsum([0, *lists.value_lengths().to_pylist()])
            best = []
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                part = low[start:end]
                most = np.array([np.bincount(column, minlength=256).argmax() for column in part.T])
                best.append(start + int((part == most).sum(1).argmax()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), members.field("class").take(pa.array(best))], names=["path", "class"])

    return rows.select("path", "voters").mapInArrow(run, "path long, class binary")


class Rule:
    """What links two sets: 100 * shared >= percent * all. `seen`: tokens that a linked pair has in common all but surely."""

    def __init__(self, percent: int):
        self.percent, p = percent, percent / 100
        # Over five standard deviations below the threshold: about one linked pair in a million has fewer.
        self.seen = max(1, math.floor(TOKENS * p - 5.3 * math.sqrt(TOKENS * p * (1 - p))))

    def likely(self, left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of two tables of bins which may be linked, and the share of equal bins among the filled
        ones. It estimates the similarity from as many members, drawn without putting back from what
        the two sets have together; small sets are seen nearly whole. Members that differ fall on one number by
        chance, which only ever finds more. A linked pair is over four and a half deviations from being missed."""
        filled, equal = 0, 0
        for high in (True, False):
            a, b = (left >> 4, right >> 4) if high else (left & 15, right & 15)
            filled = filled + ((a | b) > 0).sum(1)
            equal = equal + ((a == b) & (a > 0)).sum(1)
        p = self.percent / 100
        whole = (n + m) / (1 + p)
        spread = np.sqrt(np.maximum(filled * p * (1 - p) * np.clip((whole - filled) / np.maximum(whole - 1, 1), 0.02, 1), 0))
        return equal >= p * filled - 4.7 * spread - 0.5, equal / np.maximum(filled, 1)

    def candidates(self, low: np.ndarray, bins: np.ndarray, n: np.ndarray, group: np.ndarray, split: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs i < j of rows of different groups that may be linked, and their estimated similarity, from sketches and
        sizes. What is held grows with these pairs only. A byte of each token is compared first, which only ever finds more of them equal. `split`: only pairs of one of
        the first so many rows and one of the rest."""
        found = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
        step = max(1, 4_000_000 // (len(n) * TOKENS))
        for at in range(0, split or len(n), step):
            part, first = slice(at, min(at + step, split or len(n))), split or at
            close = (low[part, None, :] == low[None, first:, :]).sum(2, dtype=np.uint8) >= self.seen
            sizes = n[part, None], n[None, first:]
            close &= (100 * np.minimum(*sizes) >= self.percent * np.maximum(*sizes)) & (group[part, None] != group[None, first:])
            i, j = np.nonzero(close if split else np.triu(close, 1))
            for k in range(0, len(i), 4096):
                a, b = at + i[k : k + 4096], first + j[k : k + 4096]
                same, score = self.likely(bins[a], bins[b], n[a], n[b])
                for out, x in zip(found, (a, b, score)):
                    out.append(x[same])
        return tuple(map(np.concatenate, found))


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of values of one length as a matrix, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def names(column: pa.Array) -> np.ndarray:
    """Class digests as two numbers whose order is that of the bytes."""
    return np.ascontiguousarray(matrix(column, ">u8")).astype(U64)


def forest_of(a: np.ndarray, b: np.ndarray, score: np.ndarray, size: int) -> list[int]:
    """Which of the pairs make a spanning forest, taken by falling score."""
    top, keep = list(range(size)), []
    for i in np.argsort(-score, kind="stable").tolist():
        x, y = int(a[i]), int(b[i])
        while top[x] != x:
            x = top[x]
        while top[y] != y:
            y = top[y]
        if x != y:
            top[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def parcelled(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Pairs of rows of sizes `n` dealt into parcels, as places in a and b. Those of a strip of `STRIP` first members are
    taken by the second, so a parcel has few members for its pairs."""
    strip = np.unique(a, return_inverse=True)[1] // STRIP
    order = np.lexsort((a, b, strip))
    cuts = np.flatnonzero(np.diff(strip[order])) + 1
    todo, out = [part[i : i + PAIRS] for part in np.split(order, cuts) for i in range(0, len(part), PAIRS)], []
    while todo:
        part = todo.pop()
        if len(part) > 1 and n[np.union1d(a[part], b[part])].sum() > ITEMS:
            todo += np.array_split(part, 2)
        else:
            out.append(part)
    return out


def node_pairs(nodes: DataFrame, rule: Rule, forest: bool, slots: list[tuple[int, int]], parcels: bool = False) -> DataFrame:
    """Candidate pairs (a, b) of gathered nodes or blocks (slot, members: class, n, low, roots, bins, mask,
    component, side). `forest`: of each node only a spanning forest of the most similar ones; else all
    pairs whose components differ, and of members of both sides only those between them. Of the nodes below the roots
    that two documents share, the first alone passes their pair on; `mask` has the slots of a document's nodes.
    `parcels`: pairs come as parcels (members: their classes; pairs: places of two members after each other)."""
    bit = U64(1) << np.arange(len(slots), dtype=U64)

    def run(batches):
        for batch in batches:
            lists = batch.column("members")
            members = lists.flatten()
            if not len(members):
                continue
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            name, part = names(members.field("class")), names(members.field("component"))
            low, roots, bins = matrix(members.field("low"), np.uint8), matrix(members.field("roots"), "<u4"), matrix(members.field("bins"), np.uint8)
            n, mask, side = np.asarray(members.field("n")), np.asarray(members.field("mask")).view(U64), np.asarray(members.field("side"))
            left, right = [], []
            for start, end, slot in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("slot").to_pylist()):
                order = start + np.lexsort((name[start:end, 1], name[start:end, 0], side[start:end]))
                sets, group = roots[order], np.unique(part[order], axis=0, return_inverse=True)[1].ravel()
                first = int((side[order] == side[order[0]]).sum())
                a, b, score = rule.candidates(low[order], bins[order], n[order], group, first if first < len(order) else 0)
                if forest and len(a) > 1:
                    # Members of one component count as one.
                    keep = forest_of(group[a], group[b], score, len(order))
                    a, b = a[keep], b[keep]
                elif slot is not None and len(a):
                    shared = np.where(sets[a] == sets[b], bit, U64(0)).sum(1, dtype=U64) & mask[order[a]] & mask[order[b]]
                    here = (shared & (~shared + U64(1))) == bit[slot]
                    a, b = a[here], b[here]
                if parcels:
                    for some in parcelled(a, b, n[order]):
                        used, spot = np.unique(np.stack([a[some], b[some]], 1), return_inverse=True)
                        left.append(order[used])
                        right.append(spot.ravel().astype(np.int32))
                    continue
                x, y = name[order[a]], name[order[b]]
                rising = (x[:, 0] < y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] < y[:, 1]))
                left.append(order[np.where(rising, a, b)])
                right.append(order[np.where(rising, b, a)])
            digests = members.field("class")
            for x, y in zip(left, right) if parcels else ():
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], digests.take(pa.array(x))), pa.ListArray.from_arrays([0, len(y)], pa.array(y))], names=["members", "pairs"])
            if not parcels:
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(np.concatenate(left))), digests.take(pa.array(np.concatenate(right)))], names=["a", "b"])

    if parcels:
        return nodes.select("slot", "members").mapInArrow(run, "members array<binary>, pairs array<int>")
    return nodes.select("slot", "members").mapInArrow(run, "a binary, b binary").distinct()


def parcel_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of parcels (pairs, sets: at, class, items), tested on the full sets. A pair that links found before in the
    parcel already connect is passed over, so these are fewer than the parcel's members."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                sets = batch.column("sets")[row].values
                at, digests, lists = np.asarray(sets.field("at")), sets.field("class"), sets.field("items")
                items, ends = np.asarray(lists.flatten()), np.cumsum([0, *lists.value_lengths().to_pylist()])
                own = [None] * len(at)
                for i, (start, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    own[at[i]] = items[start:end]
                place, top, found = np.argsort(at), list(range(len(at))), []
                for a, b in np.asarray(batch.column("pairs")[row].values).reshape(-1, 2).tolist():
                    x, y = a, b
                    while top[x] != x:
                        x = top[x]
                    while top[y] != y:
                        y = top[y]
                    if x == y:
                        continue
                    both = np.concatenate([own[a], own[b]])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        top[max(x, y)] = min(x, y)
                        found.append((a, b))
                ordered = [sorted((digests[int(place[a])].as_py(), digests[int(place[b])].as_py())) for a, b in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[side] for x in ordered], pa.binary()) for side in (0, 1)], names=["a", "b"])

    return rows.select("pairs", "sets").mapInArrow(run, "a binary, b binary")


def row_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """Candidate pairs of rows (class, n, low, bins, other: the same fields)."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            other = batch.column("other")
            left, right = (matrix(x, np.uint8) for x in (batch.column("low"), other.field("low")))
            n, m = np.asarray(batch.column("n")), np.asarray(other.field("n"))
            good = ((left == right).sum(1) >= rule.seen) & (100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m))
            good &= rule.likely(matrix(batch.column("bins"), np.uint8), matrix(other.field("bins"), np.uint8), n, m)[0]
            pairs = [(min(a, b), max(a, b)) for a, b, g in zip(batch.column("class").to_pylist(), other.field("class").to_pylist(), good) if g and a != b]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

    return rows.select("class", "n", "low", "bins", "other").mapInArrow(run, "a binary, b binary").distinct()


class Join:
    """State of one join: the classes, links found so far and components by them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, rule: Rule, column: str):
        self.docs, self.classes, self.size, self.rule, self.column = docs, classes, size, rule, column
        self.links: list[DataFrame] = []
        self.tested: list[DataFrame] = []
        self.sets: list[DataFrame] = []
        self.parts: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> bool:
        """Tests candidate pairs on full sets; keeps the links. False: there was nothing to test."""
        if self.tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, self.tested), ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if pairs.isEmpty():
            return False
        self.tested.append(pairs)
        full = self.full_sets(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        both = pairs.join(full.select(F.col("class").alias("a"), F.col("items").alias("items_a")), "a")
        both = both.join(full.select(F.col("class").alias("b"), F.col("items").alias("items_b")), "b")
        both = both.withColumn("shared", F.size(F.array_intersect("items_a", "items_b")))
        union = F.size("items_a") + F.size("items_b") - F.col("shared")
        self.link(both.where(100 * F.col("shared") >= self.rule.percent * union).select("a", "b"))
        return True

    def confirm_parcels(self, parcels: DataFrame) -> None:
        """Tests the candidates of parcels (members, pairs) on full sets, which are joined to the members; keeps the links."""
        parcels = cut(parcels.withColumn("parcel", F.monotonically_increasing_id()))
        if parcels.isEmpty():
            return
        members = parcels.select("parcel", F.posexplode("members").alias("at", "class"))
        sets = members.join(self.full_sets(members.select("class").distinct()), "class").groupBy("parcel").agg(F.collect_list(F.struct("at", "class", "items")).alias("sets"))
        self.link(parcel_links(sets.join(parcels.select("parcel", "pairs"), "parcel"), self.rule.percent))

    def link(self, found: DataFrame) -> None:
        """Keeps confirmed links and joins the components that they connect."""
        found = cut(found)
        if not found.isEmpty():
            self.links.append(found)
            every = found
            if self.parts is not None:
                # Components found before stand for their links.
                every = every.unionByName(self.parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
            self.parts = components(every)

    def full_sets(self, wanted: DataFrame) -> DataFrame:
        """Full sets of the wanted classes alone; those of other classes stay out of the joins that follow."""
        wanted = cut(wanted)
        self.fetch(wanted)
        full = reduce(DataFrame.unionByName, self.sets)
        return full if len(self.sets) == 1 else full.join(listed(wanted), "class", "left_semi")

    def fetch(self, wanted: DataFrame) -> None:
        """Fetches the full sets of the wanted classes that are not there yet, from one text of each."""
        if self.sets:
            wanted = wanted.join(reduce(DataFrame.unionByName, self.sets).select("class"), "class", "left_anti")
        wanted = cut(wanted.join(self.classes.select("class", "text_key"), "class").select("text_key"))
        texts = self.docs.select(F.xxhash64(self.column).alias("text_key"), F.col(self.column).alias("text"))
        texts = texts.join(listed(wanted), "text_key", "left_semi")
        size = self.size

        def sets(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_A_BATCH // 4):
                    own = [shingles(t, size) for t in whole.slice(at, ROWS_A_BATCH // 4).column(0).to_pylist()]
                    names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], names=["class", "items"])

        # Copies, and texts of one class that differ where their sets do not, give one set: tasks drop those of their own first.
        self.sets.append(cut(texts.select("text").mapInArrow(sets, "class binary, items array<long>").dropDuplicates(["class"])))

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the component of their class so far."""
        rows = rows.drop("component")
        if self.parts is None:
            return rows.withColumn("component", F.col("class"))
        return rows.join(self.parts, rows["class"] == self.parts["node"], "left").withColumn("component", F.coalesce("component", "class")).drop("node")

    def unsettled(self, rows: DataFrame) -> DataFrame:
        """Rows of nodes that hold more than one component. Names alone are brought together with
        components first; sketches move only for the nodes that are left."""
        held = self.placed(rows.select("path", "class"))
        open_nodes = cut(held.groupBy("path").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("path"))
        return self.placed(rows.join(listed(open_nodes), "path", "left_semi"))

    def gathered(self, rows: DataFrame) -> DataFrame:
        """Small nodes as one row each: at most `SMALL` members, which get their sketches here only."""
        member = F.struct("class", "n", "low", "roots", "bins", "mask", "component", F.lit(0).alias("side"))
        return rows.join(self.slim, "class").groupBy("path").agg(F.min("slot").alias("slot"), F.collect_list(member).alias("members"))

    def placed_nodes(self, paths: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """Members (path, class, size, slot, mask) of the small and of the large nodes, and whether there are large ones."""
        nodes = cut(populated(paths))
        members = paths.drop("slot").join(nodes, "path")
        # A class is in as many nodes as it has slots at most.
        own = F.when(F.col("slot").isNotNull(), F.expr("shiftleft(1L, slot)")).otherwise(0)
        members = cut(members.withColumn("mask", F.bit_or(own).over(Window.partitionBy("class"))))
        large = members.where(F.col("size") > SMALL)
        return members.where(F.col("size") <= SMALL), large, not large.isEmpty()

    def stars(self, large: DataFrame) -> DataFrame:
        """Candidate pairs of the members of large nodes and one pivot each. Any member would do; one in the
        middle of the others finds the most links."""
        some = F.pmod(F.xxhash64("class", "path"), F.ceil(F.col("size") / VOTERS)) == 0
        voters = large.where(some).join(self.slim.select("class", "low"), "class").groupBy("path").agg(F.collect_list(F.struct("class", "low")).alias("voters"))
        pivots = voted(voters).join(self.slim, "class").select("path", F.struct("class", "n", "low", "bins").alias("other"))
        return row_pairs(large.join(self.slim, "class").join(listed(cut(pivots), 50_000), "path"), self.rule)

    def sketch(self, small: DataFrame, large: DataFrame | None) -> DataFrame:
        """Forests of small nodes and stars around a pivot of large ones."""
        pairs = node_pairs(self.gathered(self.placed(small)), self.rule, True, self.slots)
        return pairs if large is None else pairs.unionByName(self.stars(large)).distinct()

    def rest(self, small: DataFrame) -> DataFrame:
        """All candidates of small nodes that components found so far leave open."""
        return node_pairs(self.gathered(self.unsettled(small)), self.rule, False, self.slots)

    def run(self, threshold: float) -> None:
        self.slots = root_slots(threshold)
        small, large, any_large = self.placed_nodes(rooted(self.classes, self.slots))
        # Classes that share no node are compared with nothing, so their sketches stay where they are from here on.
        inside = cut(small.select("class").unionByName(large.select("class")).distinct())
        sketches = cut(self.classes.select("class", "n_shingles", "tokens", "bins").join(listed(inside), "class", "left_semi"))
        self.slim = slim(sketches, self.slots)
        self.confirm(self.sketch(small, large if any_large else None))
        rows = cut(self.unsettled(large)) if any_large else None
        if rows is None or rows.isEmpty():
            self.confirm(self.rest(small))
            return
        paths = branched(rows.join(sketches.select("class", "tokens"), "class"), threshold, DEEPER)
        lower, wide, any_wide = self.placed_nodes(cut(paths))
        self.confirm(self.sketch(lower, wide if any_wide else None))
        # Branches of a pair may all die or part, so what is open is compared in the nodes below the roots.
        self.confirm(self.rest(small))
        self.confirm_parcels(self.blocked(cut(self.unsettled(rows))))

    def blocked(self, rows: DataFrame) -> DataFrame:
        """All candidates of large nodes that components found so far leave open, as parcels: those outside the node's most
        frequent component against each other and against that component, in blocks of `BLOCK` by `BLOCK`."""
        by = rows.groupBy("path", "component").agg(F.count("*").alias("many"))
        largest = by.groupBy("path").agg(F.max_by("component", F.struct("many", "component")).alias("largest"), F.max("many").alias("inside"), (F.sum("many") - F.max("many")).alias("outside"))
        rows = rows.join(largest, "path").withColumn("blocks", F.ceil(F.col("inside") / BLOCK).cast("int")).withColumn("out_blocks", F.ceil(F.col("outside") / BLOCK).cast("int"))
        out, spot = ~F.col("component").eqNullSafe(F.col("largest")), F.xxhash64("class")
        # Blocks outside come first; a pair of blocks (i, j) has i <= j and at least i outside.
        own = F.when(out, F.pmod(spot, "out_blocks")).otherwise(F.col("out_blocks") + F.pmod(spot, "blocks")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(out, F.expr("sequence(0, out_blocks + blocks - 1)")).otherwise(F.expr("sequence(0, out_blocks - 1)"))))
        rows = rows.join(self.slim, "class")
        member = F.struct("class", "n", "low", "roots", "bins", "mask", "component", (F.col("own") > F.col("other")).cast("int").alias("side"))
        both = rows.groupBy("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.min("slot").alias("slot"), F.collect_list(member).alias("members"))
        return node_pairs(both, self.rule, False, self.slots, parcels=True)


def grouped(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (the smallest doc_id that links reach), kept.

    Documents of `percent` hundredths similarity and more are linked. Null, empty and blank
    texts have no shingles and are linked with nothing; a text of fewer words than `size` is one
    shingle. Rows of equal sets are always in one component, also if they share their doc_id.
    A null doc_id is never the smallest; kept means doc_id and component_id agree, both null
    included (a row without shingles is its own component). Other columns are not read.

    A row comes back for every row. What is confirmed are pairs between classes of equal sets;
    the trees miss a pair of exactly the threshold with a chance below 1e-5."""
    out = joined(docs, size, percent, key, column)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def joined(docs: DataFrame, size: int, percent: int, key: str, column: str) -> DataFrame:
    """doc_id, text_key, n_shingles, component (null without shingles) and component_id (its smallest doc_id)."""
    sketches = cut(sketched(docs, size, key, column))
    classes = cut(sketches.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("bins").alias("bins")))
    join = Join(docs, classes, size, Rule(percent), column)
    join.run(percent / 100)
    least = join.placed(classes.select("class", "least"))
    names = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(least.join(names, "component").select("class", "component", "component_id"))
    return sketches.drop("tokens", "bins").join(named, "class", "left").drop("class")


def thinned(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns; rows without shingles all stay.

    It is the row of the smallest doc_id (null ids last); of several texts under that id one by its hash,
    and of rows alike in both any one."""
    rows = cut(joined(docs, size, percent, key, column).where("n_shingles > 0").select("component", "doc_id", "text_key"))
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("stays")
    groups = cut(rows.groupBy("component").agg(stays, F.count("*").alias("many")).where("many > 1"))
    held = rows.join(listed(groups, 200_000), "component")
    mine = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key"))
    counted = cut(held.select(F.col("doc_id").alias("id__"), F.col("text_key").alias("key__"), mine.alias("mine__")).groupBy("id__", "key__", "mine__").agg(F.count("*").alias("rows__")))

    def named(names: DataFrame):
        return docs[key].eqNullSafe(names["id__"]) & (F.xxhash64(docs[column]) == names["key__"])

    # All rows of a listed name leave, but for one of each name that stays in several rows.
    gone, again = counted.where("not mine__ or rows__ > 1"), counted.where("mine__ and rows__ > 1")
    left = docs.join(listed(gone), named(gone), "left_anti")
    if again.isEmpty():
        return left
    text_key = F.xxhash64(column).alias("key__")
    one = docs.join(listed(again), named(again), "left_semi").select("*", text_key).dropDuplicates([key, "key__"]).drop("key__")
    return left.unionByName(one)
