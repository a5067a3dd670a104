"""Near duplicates: MinHash with tensored banding, candidates verified on full shingle sets.

Two collections of ``KEYS`` sub-keys (``ROWS`` minhashes each) are computed; the table keys are all pairs of a sub-key
of the one with a sub-key of the other: KEYS ** 2 tables of 2 * ROWS minhashes from 2 * KEYS * ROWS minhashes, about
the square root of what as many independent tables take. A pair at similarity 0.75 shares a table with probability
(1 - (1 - 0.75 ** ROWS) ** KEYS) ** 2 = 0.9995, more similar pairs with more, a pair at 0.3 with 0.03.

1. One scan of the texts: set size, a 128-bit digest of the set, the sub-keys, and a sketch (the least shingle of each of
   ``BINS`` ranges of hashes, a byte each) of every document: a table without texts.
2. Documents of equal sets are linked to the first; only that one goes on.
3. Sub-keys that two different sets share are marked. A table key can only be shared where both its sub-keys are, so
   documents without such go no further, and the others make table keys of marked sub-keys only.
4. Each task keeps one document a key and batch; in one shuffle by key these meet the key's first document as they stream
   by. Each document is verified against the ``HEADS`` first documents that it shares the most tables with, one batch's
   and all tables': so many pairs a document, however large its group. Components are formed.
5. What that leaves apart, in rounds. Two documents share a table just where they share a sub-key in both collections,
   so they meet under the sub-keys of the first one, a row each, and the second is looked at there. In each such key that
   still holds several components, documents outside its largest component are compared with those of other components by
   set sizes and sketches, each pair under the first sub-key that it shares. A key is dealt by blocks of ``BLOCK``
   documents on either side, so that no task holds or sees more of one key. Of the pairs that agree enough, each
   component's best ones are verified and components formed anew. In these rounds about ``PASSING`` documents speak for a
   key's largest component; the last round takes all documents and pairs that are left between components, so that none
   is lost.

Verification deals pairs by their first document, salted by the number of its pairs. No link reaches the driver.

Edge cases: texts without words link with nothing; fewer than five words are one shingle; rows equal in doc_id and text
are one document; rows of one doc_id with other texts are documents of their own, each linked by its own set; rows
without doc_id link with nothing and have a null component_id; component_id is the smallest doc_id of all texts linked;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, flat, join_sized, materialize, mix, shielded, slices, text_print, tidy
from .components import components
from .shingles import shingle_sets

KEYS, ROWS, PERCENT = 22, 4, 75
HASHES = 2 * KEYS * ROWS
BINS, SIGMAS = 512, 4.75  # a pair at 0.75 agrees too little with probability 1e-6 or less
MEMBERS = 256  # pairs of one document in one verifying group
HEADS, BLOCK, WIDTHS, PASSING = 2, 2048, (2, 16, None), 16
_random = np.random.default_rng(20)
FACTOR = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERM = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64)


def minhashes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES minima for each set (rows); empty sets get zeros."""
    out = np.zeros((len(at) - 1, HASHES), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(sets * FACTOR[k] + TERM[k], at[full])
    return out


def sub_keys(mins: np.ndarray) -> np.ndarray:
    """KEYS sub-keys of ROWS minhashes for each of the two collections."""
    sub = np.zeros((len(mins), 2 * KEYS), np.uint64)
    for r in range(ROWS):
        sub = mix(sub + mins[:, r::ROWS])
    return sub


def sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A byte for the least hash in each of BINS equal ranges, 0 where there is none; sets are sorted."""
    out = np.zeros((len(at) - 1, BINS), np.uint8)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = row * BINS + (sets >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out.reshape(-1)[place[first]] = (mix(sets[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def agreement(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """By how many ranges sketches (rows) agree beyond what they would at the similarity asked for, less SIGMAS deviations.

    The ranges' least hashes are a sample of the union without replacement, nearly all of it for small sets.
    """
    p = PERCENT / 100
    same, some = ((a == b) & (a > 0)).sum(1), ((a | b) > 0).sum(1)
    union = np.maximum((n_a + n_b) / (1 + p), some)
    spread = some * p * (1 - p) * (union - some + 1) / union
    return same - p * some + SIGMAS * np.sqrt(spread)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, print (of the text), n (set size), d1 and d2 (the set's digest), subs (sub-keys), brief (32 bits of each) and
    sketch of every whole text."""
    schema = docs.select("doc_id").schema
    for name, kind in (("print", "long"), ("n", "long"), ("d1", "long"), ("d2", "long"), ("subs", "binary"), ("brief", "binary"), ("sketch", "binary")):
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j in slices(offsets, 1 << 20):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.diff(at)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ TERM[k]), dtype=np.uint64)]) for k in (0, 1)]
                digest = [mix((s[at[1:]] - s[at[:-1]]) + size.astype(np.uint64)).view(np.int64) for s in sums]
                subs = sub_keys(minhashes(sets, at))
                rows = [pa.array([m.tobytes() for m in x], pa.binary()) for x in (subs, subs.astype(np.uint32), sketches(sets, at))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array(size), *map(pa.array, digest), *rows], names=schema.names)

    return docs.select("doc_id", text_print().alias("print"), "text").mapInArrow(tidy(run), schema)


def unpack(column) -> np.ndarray:
    return flat(column)[0].view(np.uint64).reshape(-1, 2 * KEYS)


def unpack_brief(column) -> np.ndarray:
    return flat(column)[0].view(np.uint32).reshape(-1, 2 * KEYS)


def unpack_sketch(column) -> np.ndarray:
    return flat(column)[0].reshape(-1, BINS)


def table_keys(sub: np.ndarray) -> np.ndarray:
    """KEYS ** 2 keys a document: every sub-key of the first collection with every one of the second."""
    tables = (np.arange(KEYS * KEYS, dtype=np.uint64) + np.uint64(1)).reshape(KEYS, KEYS)
    return mix(sub[:, :KEYS, None] * np.uint64(3) + sub[:, None, KEYS:] + mix(tables)).reshape(len(sub), -1)


MANY, ONE, KNOWN = range(3)


def marked(signed: DataFrame) -> DataFrame:
    """(row, mask): which sub-keys of a set another set has in the same place; sets without such are left out.

    A batch sends one row a sub-key (MANY if several of its sets have it); what its sets share is KNOWN at once. Of equal
    sets the first row of each batch speaks for all.
    """
    place = mix(np.arange(1, 2 * KEYS + 1, dtype=np.uint64))

    def own(batches):
        for batch in batches:
            row, digest = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            order = np.argsort(row, kind="stable")
            order = np.sort(order[np.unique(digest[order], return_index=True)[1]])
            row, digest, subs = row[order], digest[order], mix(unpack(batch.column(1))[order] + place)
            sub, who, bit = subs.reshape(-1), np.repeat(np.arange(len(row)), 2 * KEYS), np.tile(np.arange(2 * KEYS), len(row))
            order = np.argsort(sub, kind="stable")
            sub, who, bit = sub[order], who[order], bit[order]
            new = np.concatenate([[True], sub[1:] != sub[:-1]])[: len(sub)]
            many = np.concatenate([~new[1:], [False]])[: len(sub)]
            mask = np.zeros(len(row), np.int64)
            twice = ~new | many
            np.bitwise_or.at(mask, who[twice], np.int64(1) << bit[twice])
            known = np.flatnonzero(mask)
            kind = np.concatenate([np.where(many[new], MANY, ONE), np.full(len(known), KNOWN)]).astype(np.int64)
            salt = mix(row[known].astype(np.uint64))
            columns = [np.concatenate([sub[new], salt]).view(np.int64), kind, np.concatenate([digest[who[new]], digest[known]]), np.concatenate([row[who[new]], row[known]]), np.concatenate([np.int64(1) << bit[new], mask[known]])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sub", "kind", "digest", "row", "mask"])

    def met(batches):
        last, hot_before, held = None, False, None  # (sub, digest) of the row before; whether its sub-key is shared; its set if it is the only one
        for batch in batches:
            sub, kind, digest, row, mask = (batch.column(k).to_numpy() for k in range(5))
            known = kind == KNOWN
            rows, masks = [row[known]], [mask[known]]
            sub, kind, digest, row, mask = (x[~known] for x in (sub, kind, digest, row, mask))
            if len(sub):
                goes_on = last is not None and sub[0] == last[0]
                new = np.concatenate([[not goes_on], sub[1:] != sub[:-1]])
                lead = new | np.concatenate([[last is None or digest[0] != last[1]], digest[1:] != digest[:-1]])
                group = np.cumsum(new) - new[0]
                sets = np.bincount(group, lead)
                sets[0] += goes_on
                hot = (sets > 1) | (np.bincount(group, kind == MANY) > 0)
                hot[0] |= goes_on and hot_before
                out = lead & hot[group]
                rows.append(row[out])
                masks.append(mask[out])
                if held is not None and goes_on and hot[0]:
                    rows.append(np.array([held[0]]))
                    masks.append(np.array([held[1]]))
                if not (goes_on and group[-1] == 0 and not hot[0]):
                    first = np.flatnonzero(lead & (group == group[-1]))
                    held = (row[first[0]], mask[first[0]]) if not hot[-1] and len(first) else None
                last, hot_before = (sub[-1], digest[-1]), bool(hot[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (rows, masks)], names=["row", "mask"])

    rows = signed.select("row", "subs", "d1").mapInArrow(tidy(own), "sub long, kind long, digest long, row long, mask long")
    rows = rows.repartition("sub").sortWithinPartitions("sub", "kind", "digest", "row").mapInArrow(tidy(met), "row long, mask long")
    masks = rows.groupBy("row").agg(F.bit_or("mask").alias("mask"))
    return masks.where((F.col("mask").bitwiseAND((1 << KEYS) - 1) != 0) & (F.shiftright("mask", KEYS) != 0))


def alive(mask: np.ndarray) -> np.ndarray:
    """Which of a document's KEYS ** 2 tables have both sub-keys marked."""
    bits = (mask[:, None] >> np.arange(2 * KEYS)) & 1 > 0
    return (bits[:, :KEYS, None] & bits[:, None, KEYS:]).reshape(len(mask), -1)


def best(pair: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Of pairs (head, document): for each document the HEADS it has met the most times."""
    order = np.lexsort((pair[:, 0], -times, pair[:, 1]))
    pair = pair[order]
    new = np.flatnonzero(np.diff(pair[:, 1], prepend=pair[:1, 1] - 1)) if len(pair) else np.empty(0, np.int64)
    rank = np.arange(len(pair)) - np.repeat(new, np.diff(new, append=len(pair)))
    return pair[rank < HEADS]


def keyed(signed: DataFrame) -> DataFrame:
    """(key, row): for each key and batch its smallest document. (salt, row, with): the batch's others with their best ones,
    and each document that shares a key in the batch with itself."""

    def run(batches):
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
            row = batch.column(0).to_numpy()
            order = np.argsort(row, kind="stable")
            row, live = row[order], alive(batch.column(2).to_numpy()[order]).reshape(-1)
            keys = table_keys(unpack(batch.column(1))[order])
            key, who = keys.reshape(-1)[live], np.repeat(row, keys.shape[1])[live]
            rank = np.argsort(key, kind="stable")
            key, who = key[rank], who[rank]
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            head = who[np.flatnonzero(new)[np.cumsum(new) - 1]]
            pair, times = np.unique(np.stack([head[~new], who[~new]], 1), axis=0, return_counts=True)
            own = np.unique(pair)
            pair = np.concatenate([best(pair, times), np.stack([own, own], 1)])
            salt = mix(pair[:, 0].astype(np.uint64) * np.uint64(31) + mix(pair[:, 1].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[new], salt]).view(np.int64)), pa.array(np.concatenate([who[new], pair[:, 1]])), pa.array(np.concatenate([np.zeros(new.sum(), np.int64), pair[:, 0]]), mask=np.arange(new.sum() + len(pair)) < new.sum())], names=["key", "row", "with"])

    return signed.select("row", "subs", "mask").mapInArrow(tidy(run), "key long, row long, with long")


def star_pairs(keys: DataFrame) -> DataFrame:
    """(a, b, n): each key's documents with its first one and in how many keys, streaming through rows sorted by key."""

    def run(batches):
        last_key, head = None, None
        for batch in batches:
            if not len(batch):
                continue
            key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            paired = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            given = batch.column(2).fill_null(0).to_numpy()
            key_rows = np.flatnonzero(~paired)
            k, d = key[key_rows], doc[key_rows]
            new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
            if len(k) and last_key is not None and k[0] == last_key:
                new[0] = False
            group = np.cumsum(new)
            heads = np.concatenate([[head if head is not None else 0], d[new]])[group]
            u = np.concatenate([heads[~new], given[paired]])
            v = np.concatenate([d[~new], doc[paired]])
            if len(k):
                last_key, head = k[-1], heads[-1]
            pair, times = np.unique(np.stack([u, v], 1), axis=0, return_counts=True) if len(u) else (np.empty((0, 2), np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(times)], names=["a", "b", "n"])

    rows = keys.repartition("key").sortWithinPartitions("key", "row").mapInArrow(tidy(run), "a long, b long, n long")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


def first_pairs(stars: DataFrame) -> DataFrame:
    """(a, b): each document b with the HEADS documents a that it has met in the most keys."""
    ranked = stars.where("a <> b").withColumn("rank", F.row_number().over(W.partitionBy("b").orderBy(F.desc("n"), "a")))
    return ranked.where(F.col("rank") <= HEADS).select("a", "b")


def agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose sketches agree enough and whose set sizes allow the similarity."""
    side = reps.select("row", "n", "sketch")
    both = pairs.select("a", "b").join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    both = both.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    def run(batches):
        for batch in batches:
            sizes = [batch.column(k).to_numpy() for k in (4, 5)]
            keep = pa.array(agreement(unpack_sketch(batch.column(2)), unpack_sketch(batch.column(3)), *sizes) >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(tidy(run), "a long, b long")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= PERCENT * union on full sets; read from a written table, which the caller may discard."""
    pairs = materialize(pairs.select("a", "b"), "pairs")
    groups = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")), "groups", light=True)
    member = pairs.join(groups, "a").select(F.col("b").alias("row"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    head = groups.select(F.col("a").alias("row"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    tasks = member.unionByName(head).groupBy("row").agg(F.collect_set(F.struct("a", "salt", "role")).alias("tasks"))
    tasks = materialize(tasks.join(reps.select("row", "doc_id", "print"), "row"), "tasks", light=True)
    discard(pairs, groups)
    with_text = join_sized(docs.select("doc_id", "text", text_print().alias("print")), tasks, ["doc_id", "print"], "tasks").where("tasks IS NOT NULL")
    rows = with_text.select("row", "text", F.explode("tasks").alias("t")).select("t.a", "t.salt", "t.role", "row", "text")

    def run(batches):
        head, head_set = None, None
        for batch in batches:
            a, salt, role, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            data, offsets = flat(batch.column(4))
            us, vs = [], []
            for i, j in slices(offsets, 1 << 20):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(i, j):
                    own = sets[at[k - i] : at[k - i + 1]]
                    if role[k] == 0:
                        head, head_set = (a[k], salt[k]), own.copy()
                    elif head == (a[k], salt[k]):
                        small, large = (own, head_set) if len(own) <= len(head_set) else (head_set, own)
                        if not len(small) or 100 * len(small) < PERCENT * len(large):
                            continue
                        both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                        if 100 * both >= PERCENT * (len(small) + len(large) - both):
                            us.append(a[k])
                            vs.append(row[k])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    out = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(tidy(run), "u long, v long")
    out.work_path = tasks.work_path
    return out


def apart(sharing: DataFrame, found: DataFrame, width: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b, owner, score): pairs of different components that share a table and whose sketches agree enough, the best width
    (all if None) of each component that owns them; and the work tables behind them.

    sharing has the documents to look at. Documents outside a key's largest component are held, in blocks, and own the
    pairs; every document of the key passes each of these blocks, in blocks too; a pair counts under the first key it shares.
    """
    some = materialize(join_sized(sharing.select("row", "subs", "mask"), found, "row", "component").withColumn("component", F.coalesce("component", "row")), "sharing")

    place_of = mix(np.arange(1, KEYS + 1, dtype=np.uint64))

    def spread(batches):
        for batch in batches:
            live = (batch.column(3).to_numpy()[:, None] >> np.arange(KEYS)) & 1 > 0
            keys, times = mix(unpack(batch.column(2))[:, :KEYS] + place_of)[live], live.sum(1)
            row, component = (np.repeat(batch.column(k).to_numpy(), times) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.nonzero(live)[1]), pa.array(row), pa.array(component)], names=["key", "table", "row", "component"])

    rows = some.select("row", "component", "subs", "mask").mapInArrow(tidy(spread), "key long, table long, row long, component long")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "component"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), largest["component"].alias("most"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.sum("n") - largest["n"]) / BLOCK).cast("int").alias("held"), F.ceil(largest["n"] / PASSING).alias("spread")).where("parts > 1").drop("parts")
    mixed = materialize(mixed, "mixed", light=True)
    small = F.col("component") != F.col("most")
    if width is None:
        rows = rows.join(mixed, "key")
    else:  # the condition is part of the join: what doesn't pass isn't made
        rows = rows.join(mixed.withColumnRenamed("key", "__key"), (F.col("key") == F.col("__key")) & (small | (F.pmod(F.xxhash64("key", "row"), F.col("spread")) == 0)))
    rows = rows.withColumn("small", small)
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(F.xxhash64("row"), F.col(n)).cast("int"))
    place = lambda hold, pass_, role: F.transform(hold, lambda h: F.transform(pass_, lambda p: F.struct(h.alias("hold"), p.alias("pass"), F.lit(role).alias("role"))))
    held = F.when(F.col("small"), F.flatten(place(own("held"), up_to("blocks"), 0))).otherwise(F.array().cast("array<struct<hold:int,pass:int,role:int>>"))
    dealt = rows.select("key", "table", "row", "component", "small", F.inline(F.concat(held, F.flatten(place(up_to("held"), own("blocks"), 1)))))
    dealt = materialize(dealt, "dealt")
    told = dealt.join(sharing.select("row", "n", "brief", "sketch"), "row").select("key", "hold", "pass", "role", "small", "table", "component", "row", "n", "brief", "sketch")

    def compare(batches):
        at, kept = None, None
        for batch in batches:
            if not len(batch):
                continue
            key, hold, pass_, role = (batch.column(k).to_numpy() for k in range(4))
            small = batch.column(4).to_numpy(zero_copy_only=False)
            table, component, row, n = (batch.column(k).to_numpy() for k in range(5, 9))
            brief, sketch = unpack_brief(batch.column(9)), unpack_sketch(batch.column(10))
            us, vs, owners, scores = [], [], [], []
            change = (np.diff(key) != 0) | (np.diff(hold) != 0) | (np.diff(pass_) != 0)
            cut = np.concatenate([[0], np.flatnonzero(change) + 1, [len(key)]])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if at != (here := (key[i], hold[i], pass_[i])):
                    at, kept = here, tuple(x[:0] for x in (component, row, n, brief, sketch))
                few = i + int(np.searchsorted(role[i:j], 1))
                if few > i:
                    kept = tuple(np.concatenate([x, y[i:few]]) for x, y in zip(kept, (component, row, n, brief, sketch), strict=True))
                for k in range(few, j):
                    near = (kept[0] != component[k]) & (100 * np.minimum(kept[2], n[k]) >= PERCENT * np.maximum(kept[2], n[k]))
                    if small[k]:  # both are held somewhere and both pass: one order of them is enough
                        near &= kept[1] < row[k]
                    close = np.flatnonzero(near)
                    if len(close):
                        shared = kept[3][close] == brief[k]
                        close = close[(shared[:, :KEYS].argmax(1) == table[k]) & shared[:, KEYS:].any(1)]
                    if len(close):
                        score = agreement(kept[4][close], sketch[k : k + 1], kept[2][close], n[k])
                        close, score = close[score >= 0], score[score >= 0]
                        us.append(np.full(len(close), row[k]))
                        vs.append(kept[1][close])
                        owners.append(kept[0][close])
                        scores.append(score)
            u, v, owner = (np.concatenate([row[:0], *x]) for x in (us, vs, owners))
            score = np.concatenate([np.empty(0), *scores])
            if width is not None:
                order = np.lexsort((-score, owner))
                new = np.flatnonzero(np.diff(owner[order], prepend=owner[order][:1] - 1))
                order = order[np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order))) < width]
                u, v, owner, score = u[order], v[order], owner[order], score[order]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(u, v), np.maximum(u, v), owner, score)], names=["a", "b", "owner", "score"])

    out = told.repartition("key", "hold", "pass").sortWithinPartitions("key", "hold", "pass", "role").mapInArrow(tidy(compare), "a long, b long, owner long, score double")
    return out, [dealt, some, mixed]


def best_of_owner(pairs: DataFrame, tried: DataFrame | None, width: int | None) -> DataFrame:
    """Pairs that have not been tried, the best width of each owner."""
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    if width is None:
        return pairs.select("a", "b").distinct()
    ranked = pairs.dropDuplicates(["a", "b"]).withColumn("rank", F.row_number().over(W.partitionBy("owner").orderBy(F.desc("score"), "a", "b")))
    return ranked.where(F.col("rank") <= width).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, print (of the text), n_shingles and component_id (the smallest linked doc_id, or its own) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    # written tables on both sides of a join: adaptive execution can split a hot group of copies
    first = materialize(full.groupBy("d1", "d2").agg(F.min("row").alias("v"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "first", light=True)
    equal = materialize(full.select("row", "d1", "d2").join(first, ["d1", "d2"]).where("row <> v").select(F.col("row").alias("u"), "v"), "equal", light=True)
    masks = materialize(marked(full).join(equal, F.col("row") == equal["u"], "left_anti"), "masks", light=True)
    sharing = materialize(join_sized(full.select("row", "doc_id", "print", "n", "subs", "brief", "sketch"), masks, "row", "mask").where("mask IS NOT NULL"), "sharing")
    stars = materialize(star_pairs(keyed(sharing)), "stars")
    pairs = materialize(agreeing(first_pairs(stars), sharing), "candidates")
    checked = verified(pairs, sharing, docs)
    links = materialize(checked, "links", light=True)
    tried = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "tried", light=True)
    discard(first, masks, stars, pairs, checked)
    for width in WIDTHS:
        met = components(links)
        found = materialize(met.withColumnRenamed("node", "row"), "components", light=True)
        near, work = apart(sharing, found, width)
        pairs = materialize(best_of_owner(near, tried, width), "candidates", light=True)
        discard(met, found, *work)
        if not pairs.isEmpty():  # else the documents that spoke have none; the last round asks all
            before, checked = (links, tried), verified(pairs, sharing, docs)
            links = materialize(links.unionByName(checked), "links", light=True)
            tried = materialize(tried.unionByName(pairs), "tried", light=True)
            discard(*before, checked)
        discard(pairs)
    met = components(equal.unionByName(links))
    found = materialize(met.withColumnRenamed("node", "row"), "components", light=True)
    roots = found.select(F.col("component").alias("row"), "component").distinct()
    members = materialize(signed.select("row", "doc_id").join(found.unionByName(roots), "row"), "members", light=True)
    least = materialize(members.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least", light=True)
    named = materialize(members.join(least, "component").select("row", "component_id"), "named", light=True)
    discard(sharing, equal, links, tried, met, found, members, least)
    out = join_sized(signed.select("row", "doc_id", "print", F.col("n").alias("n_shingles")), named, "row", "component_id")
    return out.select("doc_id", "print", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.drop("print").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates, the smallest doc_id, stays.

    Texts without words, rows without doc_id, and repeated rows of the doc_id that stays all stay; an empty table gives
    an empty one; columns of any other name pass through.
    """
    plain, restore = shielded(docs, "doc_id", "text")
    key = {"__id": F.col("doc_id").cast("long"), "__print": text_print()}
    found = near_duplicates(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": "__id", "print": "__print"})
    gone = materialize(found.where("__id <> component_id").select("__id", "__print", F.lit(True).alias("__gone")).distinct(), "gone")
    return restore(join_sized(plain.withColumns(key), gone, ["__id", "__print"], "__gone").where("__gone IS NULL"))
