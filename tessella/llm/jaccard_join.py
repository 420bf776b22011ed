"""Operator 3: n-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct word shingles, as 64-bit hashes; documents with equal sets are one class (128-bit
key). A bounded counting sketch over all documents tells frequent token classes from rare ones and orders tokens: rare
before frequent, then by hash.

Keys. Let at least ``least`` tokens be shared and at most u not. The first shared token lies in the prefix of n - least + 1
tokens. If it is rare, both classes index it singly. If not, all shared tokens are frequent, the rare ones are among the u,
and the prefix is extended: of the first u + 2 shared tokens two stand side by side in both orders, since only u tokens can
come between them. So a class indexes its rare prefix tokens singly and, where fewer tokens are rare than may differ,
the combinations of two neighbours of its extended frequent prefix: their number grows with the prefix, not with its square.
(Where sharing u + 2 tokens isn't certain, as in the smallest sets, frequent prefix tokens are indexed singly too.)

Buckets of single tokens are read as a stream sorted by size; a class that has fewer than SMALL_BUCKET classes of fitting
sizes before it is paired with them, and pairs are dropped by costs and parities or verified. Denser stretches, and
buckets of combinations, become groups: each has a reference, the member that is in most such buckets, and each member its
difference from the reference. For two members |X xor Y| = |dX xor dY|, so a link needs 2 |dX and dY| >= e(X) + e(Y), where
e = |d| - n (1 - t) / (1 + t). Members with e(X) + e(reference) <= 0 are linked with the reference, and two members
with e(X) + e(Y) <= 0 are both among these. All others must share tokens of their *differences*, and the same keys are taken of
those. A member that is far from the reference (they share a passage, say) is indexed under longer
combinations of its own tokens: of (u + 1)(k - 1) + 1 shared tokens some k stand side by side in both orders, and a chance
share of k neighbours falls as a power of k. Of these buckets, those in which no two members can share enough are dropped by
their extremes of e and of what can still be shared, small ones give pairs, and large ones are groups again, now about the
member of least e, whose difference is what all of them have in common and not much more. So neither near copies nor common passages are paired with each other inside a group, and no link between components is lost.

Defined results: null, empty and blank texts have an empty set, n_shingles 0, and are linked with nothing (component_id is
their own doc_id); null doc_ids never lend a component its id, unless it has no other; equal rows stay rows of their own
and share a class; very long texts are sets like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import mix as _mix
from .shingles import parity, parity_distance, shingle_sets

#: Tokens are counted by their leading bits. Counters that reach LOCAL in a task are added up; a token is frequent from
#: LEAST_FREQUENT on, or FREQUENT times a counter's mean.
SKETCH_BITS, LOCAL, FREQUENT, LEAST_FREQUENT = 22, 3, 2, 32
#: A key row packs the set's size and the key's cost (tokens before it that would not be shared) into one number.
_COST = 24
SMALL_BUCKET = 24
#: Groups within groups. In the buckets of the last ones all pairs that can share enough are verified.
LEVELS = 2


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, then one for each counter of the task's sketch that has risen."""
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    total = 0
    seen: set[bytes] = set()
    names = ["doc_id", "text_key", "sid", "n", "parity", "bucket", "count"]
    for batch in batches:
        sid, n, bits = [], [], []
        for s in shingle_sets(common.utf8(batch.column("text")), k):
            n.append(len(s))
            sid.append(set_key(s) if len(s) else None)
            bits.append(parity(s) if len(s) else None)
            if len(s) and sid[-1] not in seen:  # copies don't make a token frequent
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sid[-1])
                np.add.at(counts, _counter(s), 1)
                total += len(s)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sid, pa.binary()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())], names=names)
    used = np.flatnonzero(counts >= LOCAL)
    none = lambda t: pa.nulls(len(used) + 1, t)
    risen = (pa.array([-1, *used], pa.int32()), pa.array([total, *counts[used]], pa.int64()))
    yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.int64()), none(pa.binary()), *risen], names=names)


def _needed(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def most_apart(n: int, num: int, den: int) -> int:
    """The most tokens that a set of n and one linked with it don't share."""
    return n * (den - num) // num


def prefix_keys(tokens: np.ndarray, ranks: np.ndarray, least: int, apart: int, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of sorted tokens that share ``least`` with any partner, ``apart`` not; each key's cost; which are combinations.

    ranks: by sketch counter, 0 for rare tokens, else higher for more frequent ones; tokens marked in ``last`` come after all
    others, as the most frequent ones. A key's cost is a number of tokens that
    can't be shared if the key is the one that tells: those before a single token, the rare ones for a combination.
    """
    p = len(tokens) - least + 1
    if p <= 0:
        return tokens[:0], np.zeros(0, np.int64), np.zeros(0, bool)
    rank = ranks[_counter(tokens)]
    if last is not None:
        rank[last] = 255
    often = rank > 0
    rare = tokens[~often]
    if len(rare) >= p:
        return rare[:p], np.arange(p), np.zeros(p, bool)
    frequent = tokens[often][np.lexsort((tokens[often], rank[often]))]
    keys, costs, combined = [rare], [np.arange(len(rare))], [np.zeros(len(rare), bool)]
    u = apart - len(rare)  # of the tokens apart, those that aren't this set's rare ones
    if u < 0:
        u = -1  # then nothing is shared unless a rare token is
    if least < u + 2:
        keys.append(frequent[: p - len(rare)])
        costs.append(np.arange(len(rare), p)[: len(keys[-1])])
        combined.append(np.ones(len(keys[-1]), bool))
    if u >= 0:
        head = frequent[: u + 2 + p - 1 - len(rare)]
        keys.append(_mix(head[:-1] * np.uint64(0xD6E8FEB86659FD93) + _mix(head[1:])))
        costs.append(np.full(len(keys[-1]), len(rare)))
        combined.append(np.ones(len(keys[-1]), bool))
    return np.concatenate(keys), np.concatenate(costs), np.concatenate(combined)


def run_keys(tokens: np.ndarray, ranks: np.ndarray, least: int, apart: int, k: int) -> np.ndarray:
    """Keys of k neighbouring tokens of the extended prefix; where not so many need stand side by side, of fewer too."""
    ordered = tokens[np.lexsort((tokens, ranks[_counter(tokens)]))]
    sure = min((least - 1) // (apart + 1) + 1, k)
    keys = []
    for m in range(sure, k + 1):
        head = ordered[: (apart + 1) * (m - 1) + 1 + len(tokens) - least]
        if len(head) < m:
            break
        h = _mix(head[: len(head) - m + 1] + np.uint64(m))
        for j in range(1, m):
            h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + head[j : len(head) - m + 1 + j])
        keys.append(h)
    return np.concatenate(keys) if keys else tokens[:0]


def _index(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()  # a class's keys once for each task
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for s in shingle_sets(common.utf8(batch.column("text")), k):
            if not len(s):
                continue
            sid = set_key(s)
            if sid in seen:
                continue
            if len(seen) >= 200_000:
                seen.clear()
            seen.add(sid)
            n = len(s)
            keys, costs, often = prefix_keys(s, ranks, _needed(n, num, den), most_apart(n, num, den))
            rows.append((sid, keys, (n << _COST) + costs, often))
            held += len(keys)
            if held > 500_000:
                yield _keys(rows)
                rows, held = [], 0
        if rows:
            yield _keys(rows)


def _keys(rows: list[tuple]) -> pa.RecordBatch:
    at = pa.array(np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows]))
    columns = [pa.array(np.concatenate([r[1] for r in rows]).view(np.int64)), pa.array(np.concatenate([r[2] for r in rows]), pa.int64()), pa.array([r[0] for r in rows], pa.binary()).take(at), pa.array(np.concatenate([r[3] for r in rows]))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "n", "sid", "often"])


def _pairs(batches: Iterator[pa.RecordBatch], num: int, den: int, small: int) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by often, key, n, sid: pairs to verify (key null), and members (b null) of groups.

    Only the last ``small`` members of a bucket are kept in memory; keys marked ``often`` are passed on.
    """
    mask = (1 << _COST) - 1
    key, last, dense, stretch = None, None, False, 0
    before: deque[tuple[int, bytes]] = deque(maxlen=small)
    rows: list[tuple] = []
    for batch in batches:
        often = np.asarray(batch.column("often").cast(pa.int8())).astype(bool)
        if often.any():
            passed = batch.filter(pa.array(often))
            yield pa.RecordBatch.from_arrays([passed.column("sid"), pa.nulls(len(passed), pa.binary()), passed.column("key")], names=["a", "b", "key"])
            batch = batch.filter(pa.array(~often))
        ks = np.asarray(batch.column("key"))
        if not len(ks):
            continue
        # members of buckets of one, which are most, are skipped at once
        same = ks[1:] == ks[:-1]
        many = np.zeros(len(ks), bool)
        many[1:] |= same
        many[:-1] |= same
        many[0] = many[-1] = True  # their buckets can go on in another batch
        at = np.flatnonzero(many)
        ns, sids = np.asarray(batch.column("n"))[at].tolist(), batch.column("sid").take(pa.array(at)).to_pylist()
        for kk, y, sid in zip(ks[at].tolist(), ns, sids):
            if kk != key:
                key, last, dense, stretch = kk, None, False, 0
                before.clear()
            if last == (y, sid):
                continue
            last = (y, sid)
            n, cost = y >> _COST, y & mask
            if len(before) == small and (before[0][0] >> _COST) * den >= n * num:
                if not dense:
                    stretch += 1
                    group = _signed(key * 0x9E3779B97F4A7C15 + stretch)
                    rows += [(s, None, group) for _, s in before]
                    dense = True
                rows.append((sid, None, group))
            else:
                dense = False
                for x, s in before:
                    m = x >> _COST
                    if m * den >= n * num and ((x & mask) + cost) * (den + num) <= (n + m) * (den - num):
                        rows.append((min(s, sid), max(s, sid), None))
            before.append(last)
        if len(rows) > 50_000:
            yield _pair_rows(rows)
            rows = []
    if rows:
        yield _pair_rows(rows)


def _signed(x: int) -> int:
    return ((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def _pair_rows(rows: list[tuple]) -> pa.RecordBatch:
    rows = list(dict.fromkeys(rows))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "key"])


def _near(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities leave a link possible."""
    for batch in batches:
        rows = []
        for a, b, n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "pa", "pb"))):
            if parity_distance(x, y) * (den + num) <= (n + m) * (den - num):
                rows.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    a = classes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    b = classes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(lambda it: _near(it, num, den), "a binary, b binary")


def _groups(members: DataFrame) -> DataFrame:
    """ref, sid: for each key of members(key, sid, e) with several, all others with the one of the least e."""
    refs = members.groupBy("key").agg(F.count("*").alias("size"), F.min_by("sid", F.struct("e", "sid")).alias("ref"))
    return members.join(refs.filter("size > 1").select("key", "ref"), "key").filter("sid <> ref").select("ref", "sid").distinct()


def _first_groups(members: DataFrame) -> DataFrame:
    """Groups of members(key, sid) about what they are likely to be copies of.

    A bucket's first choice is its member that is in most buckets; its reference is the best choice of all buckets that
    the first choice is in: so buckets of copies that lack the same token are compared with the original as well, which
    needn't be in the bucket.
    """
    load = members.groupBy("sid").agg(F.count("*").alias("load"))
    choice = members.join(load, "sid").groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("load", "sid")).alias("ref")).filter("size > 1").select("key", "ref")
    both = members.join(choice, "key")
    lead = both.groupBy("sid").agg(F.max("ref").alias("lead"))
    refs = choice.join(lead, F.col("ref.sid") == lead["sid"]).select("key", F.col("lead.sid").alias("ref"))
    return members.join(refs, "key").filter("sid <> ref").select("ref", "sid").distinct()


#: The bitmap of wanted classes has about 16 bits for each, and from 4 to 64 million.
_LEAST_BITS, _MOST_BITS = 22, 26


def _wanted(sids: DataFrame) -> np.ndarray:
    """A bitmap, built by Spark, that has the bit of every sid (and of others): at most 8 MB come to the driver."""
    size = sids.count()
    bits = min(max(_LEAST_BITS, (16 * size).bit_length()), _MOST_BITS)
    numbers = sids.select((F.conv(F.hex(F.substring("sid", 1, 4)), 16, 10).cast("long") % (1 << bits)).alias("bit"))
    words = numbers.groupBy(F.bitmap_bucket_number("bit").alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    wanted = np.zeros(1 << bits, bool)
    for r in words:  # word 0 has the bit of 0; word w has those from 1 + (w - 1) * 32768 on
        at = (r["word"] - 1) * 32768 + 1 if r["word"] > 0 else 0
        got = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)[: len(wanted) - at]
        wanted[at : at + len(got)] |= got
    return np.packbits(wanted, bitorder="little")


def _sets(batches: Iterator[pa.RecordBatch], k: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """sid and tokens of classes that the bitmap names, once for each task."""
    seen: set[bytes] = set()
    last = 8 * len(wanted) - 1
    for batch in batches:
        rows = []
        for s in shingle_sets(common.utf8(batch.column("text")), k):
            if not len(s):
                continue
            sid = set_key(s)
            at = int.from_bytes(sid[:4], "big") & last
            if wanted[at >> 3] >> (at & 7) & 1 and sid not in seen:
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sid)
                rows.append((sid, s.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["sid", "tokens"])


def _linked(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = [], []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if den * shared >= num * (len(both) - shared):
                u.append(a)
                v.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the token sets x of column a and y of column b."""
    return pairs.join(sets.select(F.col("sid").alias(a), F.col("tokens").alias("x")), a).join(sets.select(F.col("sid").alias(b), F.col("tokens").alias("y")), b)


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) that are linked, by their sets."""
    return _with_sets(pairs.select("a", "b"), sets, "a", "b").mapInArrow(lambda it: _linked(it, num, den), "u binary, v binary")


_DIFFERENCE = "ref binary, sid binary, key long, e long, f long, far boolean"


def _differences(batches: Iterator[pa.RecordBatch], num: int, den: int, ranks: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """For each (ref, sid), with their tokens x and y: a row without key, ``far`` unless they are linked; then sid's keys.

    Keys are of its difference from the reference's tokens if that is at most one and a half times the set, else of k of its own tokens; of
    both, if a class linked with it could be on the other side. e and f are in units of 1 / (den + num): two classes can be
    linked only if the e of each is at most the other's f.
    """
    unit = den + num
    own = None
    for batch in batches:
        rows: list[tuple] = []
        for ref, sid, x, y in zip(*(batch.column(c).to_pylist() for c in ("ref", "sid", "x", "y"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            n, d = len(y), np.setxor1d(x, y, assume_unique=True)
            e, e_ref = unit * len(d) - (den - num) * n, -(den - num) * len(x)
            far = e + e_ref > 0
            apart = most_apart(n, num, den)
            rows.append((ref, sid, np.zeros(1, np.uint64), e, np.zeros(1, np.int64), far, True))
            if 2 * len(d) <= 3 * n:
                # a partner's e is e_ref at least, and above -e_ref where one of the two has to be far
                least = max(1, len(d) - apart, -((-e - e_ref if far else e_ref - e - 1) // (2 * unit)))
                # what the reference has and this set lacks, many members of its group lack
                keys, costs, _ = prefix_keys(d, ranks, least, apart, np.isin(d, x, assume_unique=True))
                rows.append((ref, sid, _mix(keys ^ _mix(np.frombuffer(ref[:8], np.uint64))), e, 2 * unit * (len(d) - costs) - e, far, False))
            if 2 * (len(d) + apart) * den > 3 * num * n and sid != own:
                own = sid  # of several references one is enough
                keys = run_keys(y, ranks, _needed(n, num, den), apart, k)
                rows.append((ref, sid, keys, 2 * num * n, np.full(len(keys), 2 * den * n), True, False))
        if rows:
            at = pa.array(np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]))
            take = lambda i, t: pa.array([r[i] for r in rows], t).take(at)
            keys = pa.array(np.concatenate([r[2] for r in rows]).view(np.int64), mask=np.repeat([r[6] for r in rows], [len(r[2]) for r in rows]))
            columns = [take(0, pa.binary()), take(1, pa.binary()), keys, take(3, pa.int64()), pa.array(np.concatenate([r[4] for r in rows]).astype(np.int64)), take(5, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["ref", "sid", "key", "e", "f", "far"])


def _group_links(groups: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int, ranks: np.ndarray, small: int, scratch: common.Scratch) -> list[DataFrame]:
    """Links(u, v) that connect what is connected inside the groups(ref, sid)."""
    found = []
    for level in range(LEVELS):
        name = f"differences_{level}"
        rows = scratch.put(name, _with_sets(groups, sets, "ref", "sid").mapInArrow(lambda it, k=level + 4: _differences(it, num, den, ranks, k), _DIFFERENCE))
        found.append(scratch.put(f"near_{level}", rows.filter("key IS NULL AND NOT far").select(F.col("ref").alias("u"), F.col("sid").alias("v"))))
        keyed = rows.filter("key IS NOT NULL").select("key", "sid", "e", "f", "far")
        far = F.col("far")
        ends = keyed.groupBy("key").agg(
            F.count("*").alias("size"), F.max("f").alias("f_any"), F.min("e").alias("e_any"), F.max(F.when(far, F.col("f"))).alias("f_far"), F.min(F.when(far, F.col("e"))).alias("e_far")
        )
        fit = F.when(far, (F.col("e") <= F.col("f_any")) & (F.col("f") >= F.col("e_any"))).otherwise((F.col("e") <= F.col("f_far")) & (F.col("f") >= F.col("e_far")))
        left = scratch.put(f"left_{level}", keyed.join(ends.filter("size > 1 AND f_far IS NOT NULL"), "key").filter(fit).select("key", "sid", "e", "f", "far"))
        scratch.drop(name)
        sizes = left.groupBy("key").agg(F.count("*").alias("size"), F.bool_or("far").alias("any_far")).filter("size > 1 AND any_far")
        paired = sizes if level == LEVELS - 1 else sizes.filter(F.col("size") <= small)
        few = left.join(paired.select("key"), "key")
        x, y = (few.select("key", *(F.col(c).alias(c + i) for c in ("sid", "e", "f", "far"))) for i in ("1", "2"))
        pairs = x.join(y, "key").filter("sid1 < sid2 AND (far1 OR far2) AND e1 <= f2 AND e2 <= f1").select(F.col("sid1").alias("a"), F.col("sid2").alias("b")).distinct()
        found.append(scratch.put(f"met_{level}", _links(_possible(pairs, classes, num, den), sets, num, den)))
        large = left.join(sizes.filter(F.col("size") > small).select("key"), "key").groupBy("key", "sid").agg(F.min("e").alias("e"))
        if level == LEVELS - 1:
            break
        large = scratch.put(f"large_{level}", large)
        scratch.drop(f"left_{level}")
        if large.isEmpty():
            break
        groups = _groups(large)
    return found


def near_duplicates(docs: DataFrame, k: int = 3, similarity: tuple[int, int] = (90, 100), small: int = SMALL_BUCKET) -> DataFrame:
    """doc_id, text_key, sid, n_shingles, component_id, root for each row of docs(doc_id, text).

    Rows with an equal ``sid`` (null: no shingles) have equal sets; ``root`` is one sid for each component.
    """
    num, den = similarity
    scratch = common.Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    first = scratch.put("profile", texts.mapInArrow(lambda it: _profile(it, k), "doc_id long, text_key long, sid binary, n long, parity binary, bucket int, count long"))
    risen = first.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("count"))
    total = risen.filter("bucket = -1").agg(F.sum("count")).first()[0] or 0
    ranks = np.zeros(1 << SKETCH_BITS, np.uint8)
    bar = max(FREQUENT * total / len(ranks), LEAST_FREQUENT)
    high = risen.filter((F.col("bucket") >= 0) & (F.col("count") >= bar)).toArrow()  # at most half of the counters, 12 bytes each
    ranks[np.asarray(high.column("bucket"))] = np.log2(np.asarray(high.column("count")) / bar).astype(np.uint8) + 1
    index = texts.mapInArrow(lambda it: _index(it, k, num, den, ranks), "key long, n long, sid binary, often boolean")
    # keys of frequent tokens are not looked at here, so their buckets need not be in one task
    dealt = index.repartition("key", F.when(F.col("often"), F.pmod(F.xxhash64("sid"), F.lit(64))).otherwise(F.lit(0))).sortWithinPartitions("often", "key", "n", "sid")
    found = scratch.put("found", dealt.mapInArrow(lambda it: _pairs(it, num, den, small), "a binary, b binary, key long"))
    classes = scratch.put("classes", first.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("parity").alias("parity")))
    pairs = scratch.put("pairs", _possible(found.filter("b IS NOT NULL").select("a", "b").distinct(), classes, num, den))
    members = scratch.put("members", found.filter("key IS NOT NULL").select("key", F.col("a").alias("sid")).distinct())
    scratch.drop("found")
    groups = scratch.put("groups", _first_groups(members))
    scratch.drop("members")
    wanted = _wanted(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).unionByName(groups.select("sid")).unionByName(groups.select(F.col("ref").alias("sid"))))
    sets = texts.mapInArrow(lambda it: _sets(it, k, wanted), "sid binary, tokens binary")
    sets = scratch.put("sets", sets.groupBy("sid").agg(F.first("tokens").alias("tokens")))
    links = scratch.put("linked", _links(pairs, sets, num, den))
    scratch.drop("pairs")
    if not groups.isEmpty():
        for more in _group_links(groups, classes, sets, num, den, ranks, small, scratch):
            links = links.unionByName(more)
    scratch.drop("sets")
    comps = components(links, scratch)
    roots = classes.join(comps, classes["sid"] == comps["node"], "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    roots = scratch.put("roots", roots)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    roots = roots.select("sid", "root").join(least, "root")
    rows = first.filter("bucket IS NULL").select("doc_id", "text_key", "sid", "n")
    out = rows.join(roots, "sid", "left")
    own = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = scratch.put("rows", out.select("doc_id", "text_key", "sid", F.col("n").alias("n_shingles"), own.alias("component_id"), "root"))
    scratch.drop(*(name for name in list(scratch.paths) if name != "rows"))
    return out


def keep_one(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; rows without words all stay."""
    near = near_duplicates(docs, k, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("d"), F.col("text_key").alias("t"))).alias("m")
    chosen = near.filter("root IS NOT NULL").groupBy("root").agg(first).select("m.d", "m.t")
    times = near.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.count("*").alias("times"))
    same = F.col("d").eqNullSafe(F.col("cd")) & (F.col("t") == F.col("ct"))
    chosen = times.join(chosen.select(F.col("d").alias("cd"), F.col("t").alias("ct")), same, "left_semi").withColumn("once", F.lit(True))
    bare = near.filter("root IS NULL").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct().select("d", "t", F.lit(1).cast("long").alias("times"), F.lit(False).alias("once"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d0"), F.xxhash64(F.col("text").cast("string")).alias("t0"))
    kept = packed.join(chosen.unionByName(bare), F.col("d0").eqNullSafe(F.col("d")) & (F.col("t0") == F.col("t")))
    # only rows that repeat with their id and text need another look
    one = kept.filter("once AND times > 1").dropDuplicates(["d0", "t0"])
    return kept.filter("NOT once OR times = 1").unionByName(one).select("row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS g FROM w, range(1, greatest(CAST(len(ws) AS BIGINT) - 1, 2)) x(i) WHERE len(ws) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS r1, b.r AS r2, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT r1, r2 FROM p JOIN n x ON x.r = r1 JOIN n y ON y.r = r2 WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT r1 AS u, r2 AS v FROM l UNION ALL SELECT r2, r1 FROM l),
reach(u, v) AS (SELECT r, r FROM w UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM w LEFT JOIN n USING (r) JOIN reach ON reach.u = w.r JOIN w o ON o.r = reach.v GROUP BY w.r, w.doc_id, n.n
"""
