"""The prefix trie of rebuilt conversations, its subtree totals by leaf-peeling message passing.

A node is a sequence of first turns. It is known by its depth and a 120-bit fingerprint, the sum of the hashes of (place, turn) up to
there, so a node's parent is that less its own last hash, and no conversation is ever gathered: places and fingerprints are running
sums, added up by ranges of turns (running.py), so a conversation of any length is spread over tasks. Grouping by fingerprint checks
that the members' last turns agree.

Peeling. Each node belongs to the member with the smallest hash of its id. A conversation's nodes are a path that ends where it ends,
so the trie falls into paths. A path holds a counter of the paths that still hang on it, and the totals received so far; a path whose
counter has come to 0 sends its subtree's totals to the path above, as one message, and is done; the messages to a path are added up
before they are shuffled, and lower its counter. Rounds go on until only the root's path is left and finishes. Members are ranked by a
hash, so the paths between a leaf and the root change owner about ln(n) times at most, whatever the conversations' depths: a few
rounds, each with narrower tables, where peeling node by node would take one a turn. At last each node's totals are the sums over its
path from the end up to it, with what the paths below have sent to it: running sums again.

`ends_sha256` hashes the ids of a node's d-turn members one after the other. Ids are sorted by ranges, joined in each range into
strings of at most `CHUNK` ids, and a task reads a node's few strings in order into one SHA-256: it holds a batch of them at a time.

Defined cases. Turns are ordered by turn, null first, equal ones by the MD5 of (role, text); null role or text is empty. Rows that repeat
a turn are turns of their own. Rows without a conv_id take no part. A conversation that is rebuilt without turns is a member of the
root only. An empty table gives an empty result: no conversation, no root. Other columns are dropped, so their names can't clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.running import ranged, running
from textloom.llm.storage import dropped, written

BLOCK, SHARED, CHUNK = 100, 6, 4096
#: Fingerprints are two sums modulo this.
MOD = 1 << 60


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes for a turn; the role's length keeps the two apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def halves(data: Column) -> list[Column]:
    """Two numbers of 60 bits from an MD5."""
    h = F.md5(data)
    return [F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16)]


def digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, key (the turn's digest), chars, uid; written, so that uid stays the same. Texts go no further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("key"), F.length(text).cast("long").alias("chars"))
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "turns")


def rebuilt(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """conv, seg, turn, key, chars, uid: the rebuilt conversations' turns, in the order of (seg, turn, key, uid), each with a textless row before the first (seg -1). turns: from `digests`. Written by ranges of that order."""
    order = [F.col("turn").asc_nulls_first(), F.col("key"), F.col("uid")]
    # the first turns only: a window with a limit on the rank keeps as few rows of a long conversation before it is shuffled
    first = turns.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(*order))).where(F.col("rank") <= max(shared - 1, 1))
    first = written(first.withColumn("i", F.col("rank") - 1).drop("rank"), "first")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).cast("int")
    base = F.col("conv") - F.col("conv") % block
    convs = first.where("i = 0").select("conv", base.alias("base"), F.when(base == F.col("conv"), 0).otherwise(h).alias("h"))
    # the base's first h turns: at most block * (shared - 1) rows a base
    lent = convs.where("h > 0").join(first.withColumnRenamed("conv", "base"), "base").where("i < h").select("conv", F.lit(0).alias("seg"), F.col("i").cast("long").alias("turn"), "key", "chars", "uid")
    # the own turns after the first h: those behind the h-th, or none if there are fewer
    cut = convs.where("h > 0").join(first, "conv").where("i < h").groupBy("conv").agg(F.max_by(F.struct("turn", "key", "uid"), "i").alias("cut"))
    t = F.coalesce(F.col("turn"), F.lit(-(1 << 63)))
    c = F.coalesce(F.col("cut.turn"), F.lit(-(1 << 63)))
    # a null turn comes before the smallest number, too
    known, cut_known = F.col("turn").isNotNull().cast("int"), F.col("cut.turn").isNotNull().cast("int")
    behind = F.struct(known.alias("n"), t.alias("t"), F.col("key").alias("k"), F.col("uid").alias("u")) > F.struct(cut_known.alias("n"), c.alias("t"), F.col("cut.key").alias("k"), F.col("cut.uid").alias("u"))
    own = turns.join(cut, "conv", "left").where(F.col("cut").isNull() | behind).select("conv", F.lit(1).alias("seg"), "turn", "key", "chars", "uid")
    null = lambda kind: F.lit(None).cast(kind)
    roots = convs.select("conv", F.lit(-1).alias("seg"), null("long").alias("turn"), null("binary").alias("key"), F.lit(0).cast("long").alias("chars"), null("long").alias("uid"))
    dealt = ranged(roots.unionByName(lent).unionByName(own), "conv", in_order())
    dropped(first)
    return dealt


def in_order() -> list[Column]:
    """Of a rebuilt conversation's turns."""
    return [F.col("seg"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("uid")]


def prefixes(dealt: DataFrame) -> DataFrame:
    """conv, depth, a, b (the node's fingerprint), pa, pb (its parent's), key, chars, last (whether the conversation ends here), rank (of the conversation among the members of a node). One row a conversation and depth, written."""
    # the textless rows count nothing, so places start at 1
    placed = running(dealt, "conv", in_order(), {"depth": (F.col("seg") >= 0).cast("long")})
    data = F.concat(F.col("depth").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("key"))
    x, y = halves(data)
    zero = F.lit(0).cast("decimal(38,0)")
    hashed = placed.withColumn("x", F.when(F.col("depth") > 0, x).otherwise(zero)).withColumn("y", F.when(F.col("depth") > 0, y).otherwise(zero))
    placed = written(hashed.select("conv", "part", "depth", "key", "chars", "x", "y"), "placed")
    summed = running(placed, "conv", [F.col("depth")], {"sx": F.col("x"), "sy": F.col("y")})
    mod = lambda c: F.pmod(c.cast("decimal(38,0)"), F.lit(MOD).cast("decimal(38,0)")).cast("long")
    s, t, u, v = (F.col(c) for c in ("sx", "sy", "x", "y"))
    n = placed.groupBy("conv").agg(F.max("depth").alias("turns"))
    found = written(
        summed.join(n, "conv").select("conv", F.col("depth").cast("long").alias("depth"), mod(s).alias("a"), mod(t).alias("b"), mod(s - u).alias("pa"), mod(t - v).alias("pb"), "key", "chars", (F.col("depth") == F.col("turns")).alias("last"), F.xxhash64("conv").alias("rank")),
        "prefixes",
    )
    dropped(placed)
    return found


def nodes(prefixed: DataFrame) -> DataFrame:
    """The trie: depth, a, b, pa, pb, conv_id (smallest member), n_convs, chars, owner, n_children. Written."""
    agree = F.when(F.min("key").eqNullSafe(F.max("key")), F.first("chars")).otherwise(F.raise_error(F.lit("two sequences of turns share a fingerprint")).cast("long"))
    found = prefixed.groupBy("depth", "a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), agree.alias("chars"), F.min(F.struct("rank", "conv"))["conv"].alias("owner"))
    found = written(found, "nodes")
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    whole = written(found.join(children, ["depth", "a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    dropped(found)
    return whole


def with_parents(trie: DataFrame) -> DataFrame:
    """trie with parent_conv_id and parent_owner (null: the root)."""
    up = trie.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("parent_owner"))
    # a parent with very many children: its row is joined to them all, and adaptive execution splits the children
    return trie.join(up, ["depth", "pa", "pb"], "left")


def peel(paths: DataFrame) -> DataFrame:
    """owner, up (the path above; null: the root's), at (the depth there on which it hangs), leaves, saved (of the subtree) of each path. paths: owner, up, at, leaves, saved (of its own nodes).

    Every round the paths whose counter is 0 send their totals up and leave."""
    counters = paths.where("up is not null").groupBy(F.col("up").alias("owner")).agg(F.count("*").alias("waiting"))
    left = written(paths.join(counters, "owner", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0))), "paths")
    done, tables = [], [left]
    while True:
        ready = left.where("waiting = 0").drop("waiting")
        done.append(ready)
        messages = ready.where("up is not null").groupBy(F.col("up").alias("owner")).agg(F.count("*").alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        told = left.where("waiting > 0").join(messages, "owner", "left")
        got = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
        left = written(told.select("owner", "up", "at", got("leaves", "l"), got("saved", "s"), (F.col("waiting") - F.coalesce("n", F.lit(0))).alias("waiting")), "paths")
        tables.append(left)
        if left.isEmpty():
            break
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    whole = written(whole, "peeled")
    dropped(*tables)
    return whole


def totals(trie: DataFrame) -> DataFrame:
    """trie (of `nodes`) with parent_conv_id, and n_leaves and saved_tokens over each node's subtree."""
    trie = written(with_parents(trie), "trie")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    # a path's top is the one node whose parent belongs to another
    top = F.col("parent_owner").isNull() | (F.col("parent_owner") != F.col("owner"))
    paths = written(trie.groupBy("owner").agg(F.max(F.when(top, F.col("parent_owner"))).alias("up"), F.min(F.col("depth") - 1).alias("at"), F.sum(leaf).alias("leaves"), F.sum(saved).alias("saved")), "paths")
    peeled = peel(paths)
    sent = peeled.where("up is not null").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    own = trie.join(sent, ["owner", "depth"], "left").withColumn("l", leaf + F.coalesce("l", F.lit(0))).withColumn("s", saved + F.coalesce("s", F.lit(0)))
    order = [F.desc("depth")]
    dealt = ranged(own, "owner", order)
    dropped(trie, paths, peeled)
    return running(dealt, "owner", order, {"n_leaves": F.col("l"), "saved_tokens": F.col("s")})


def ends(prefixed: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: of the nodes at which conversations end."""
    import pyarrow as pa

    parts = int(prefixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = ["depth", "a", "b"]
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def joined(batches):
        # rows are sorted by node and id: runs of a node become strings
        at, held = None, []

        def row():
            return pa.RecordBatch.from_pydict({"depth": [at[0]], "a": [at[1]], "b": [at[2]], "first": [held[0]], "ids": [",".join(map(str, held))]}, schema=schema)

        for batch in batches:
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*node, "conv")), strict=True):
                if at != key or len(held) >= CHUNK:
                    if held:
                        yield row()
                    at, held = key, []
                held.append(conv)
        if held:
            yield row()

    def hashed(batches):
        at, sha = None, None
        out = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
        done: list[tuple] = []
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*node, "ids")), strict=True):
                if at != key:
                    if at:
                        done.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
                if len(done) >= 10_000:
                    yield table()
                    done.clear()
        if at:
            done.append((*at, sha.hexdigest()))
        if done:
            yield table()

    members = prefixed.where("last").select(*node, "conv").repartitionByRange(parts, *node, "conv").sortWithinPartitions(*node, "conv")
    strings = members.mapInArrow(joined, "depth long, a long, b long, first long, ids string")
    return strings.repartition(parts, *node).sortWithinPartitions(*node, "first").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def trie(turns: DataFrame, block: int = BLOCK, shared: int = SHARED, **columns: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node of the rebuilt conversations' trie. block, shared: c starts with up to shared - 1 turns of c - c % block."""
    digested = digests(turns, **columns)
    dealt = rebuilt(digested, block, shared)
    prefixed = prefixes(dealt)
    dropped(digested, dealt)
    found = nodes(prefixed)
    whole = totals(found)
    dropped(found)
    none = hashlib.sha256(b"").hexdigest()
    return whole.join(ends(prefixed), ["depth", "a", "b"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long"), F.col("saved_tokens").cast("long"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: DuckDB has no CRC-32: its table by eight shifts a byte, then a fold over the digits.
OP13_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x // 2, 3988292384 * (x % 2)))) AS t),
cv AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
hs AS (SELECT c, c - c % 100 AS base, CASE WHEN c % 100 = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])), 4294967295) % 6 END AS h FROM cv, tab),
o AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
rb AS (SELECT hs.c, 0 AS seg, i, role, text FROM hs JOIN o ON o.c = base WHERE i < h UNION ALL SELECT hs.c, 1, i, role, text FROM hs JOIN o USING (c) WHERE i >= h),
ps AS (SELECT c, row_number() OVER w AS d, length(text) AS chars, list(sha256(strlen(role) || ':' || role || text)) OVER w AS p FROM rb WINDOW w AS (PARTITION BY c ORDER BY seg, i ROWS UNBOUNDED PRECEDING)),
px AS MATERIALIZED (SELECT c, d, chars, sha256(array_to_string(p, ',')) AS p FROM ps UNION ALL SELECT c, 0, 0, '' FROM cv),
ln AS (SELECT c, max(d) AS n FROM px GROUP BY c),
nd AS MATERIALIZED (SELECT p, min(c) AS c, any_value(d) AS d, count(*) AS n_convs, any_value(chars) AS chars FROM px GROUP BY p),
up AS (SELECT nd.p, x.p AS pp FROM nd JOIN px x ON x.c = nd.c AND x.d = nd.d - 1),
ch AS (SELECT pp AS p, count(*) AS n FROM up GROUP BY pp),
sub AS (SELECT x.p, sum((ch.n IS NULL)::INT)::BIGINT AS n_leaves, sum((nd.n_convs - 1) * nd.chars)::BIGINT AS saved FROM nd LEFT JOIN ch USING (p) JOIN px x ON x.c = nd.c AND x.d <= nd.d GROUP BY x.p),
en AS (SELECT px.p, sha256(string_agg(px.c::VARCHAR, ',' ORDER BY px.c)) AS e FROM px JOIN ln ON ln.c = px.c AND ln.n = px.d GROUP BY px.p)
SELECT nd.c AS conv_id, nd.d AS depth, pn.c AS parent_conv_id, nd.n_convs, coalesce(ch.n, 0) AS n_children, n_leaves, saved AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nd LEFT JOIN ch USING (p) JOIN sub USING (p) LEFT JOIN en USING (p) LEFT JOIN up USING (p) LEFT JOIN nd pn ON pn.p = up.pp
"""
