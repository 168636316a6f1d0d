"""A trie of conversations' prefixes, and totals over its subtrees by parallel tree contraction.

Turns become 128-bit values of place and content at once; the exclusive or of a conversation's first
d values names its prefix of d turns, so prefixes are running values in ranges of rows and no
conversation is held by a task. Equal prefixes are one node; a node is known by its smallest member
and its depth. Subtree totals come from contraction: rounds rake all leaves into their parents and
compress every other node of unary chains by bits of the depth, until the root is left; what was
compressed is expanded by pointer doubling. A round is a few joins over what is left, and the
number of rounds is logarithmic in the length of chains and at most the number of branchings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, passing, running_within, table_rows, written

#: Conversations share the turns of the first of so many; and at most this many turns are shared.
FAMILY, HEADS = 100, 6
#: Characters of ids in one piece of a node's list of ends.
PIECE = 4_096


def _turns(talks: DataFrame) -> DataFrame:
    """``(conv_id, rank, item, points)``: every turn's place in its conversation, digest and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = talks.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("item"), F.length(text).cast("long").alias("points"))
    one = turns.withColumn("one", F.lit(1).cast("long"))
    return running_within(one, "conv_id", ["turn", "item"], {"rank": ("sum", "one")}, "turns").drop("turn", "one")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family: crc32 of its decimal id, mod HEADS."""
    return F.crc32(conv.cast("string")) % HEADS


def rebuilt(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(turns(conv_id, place, item, points), convs(conv_id, turns))`` with the family's first turns put in front."""
    turns = _turns(talks)
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("rank") < HEADS))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": shared_turns(F.col("conv_id")), "head": F.col("conv_id") - F.col("conv_id") % FAMILY})
    there = heads.groupBy(F.col("conv_id").alias("head")).agg(F.count("*").alias("there"))
    convs = convs.join(there, "head", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    convs = written(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))), "conversations")
    first = convs.select("conv_id", "head", "taken").join(heads.select(F.col("conv_id").alias("head"), "rank", "item", "points"), "head").where("rank <= taken").select("conv_id", F.col("rank").alias("place"), "item", "points")
    # one row a conversation against its turns: a conversation of very many turns is one that Spark splits
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("taken")).alias("place"), "item", "points")
    return first.union(rest), convs.select("conv_id", "turns")


def _nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes ``(conv_id, depth, k1, k2, parent_conv_id, n_convs, points)``, the root last; keys are the prefix's values."""
    half = lambda seed: F.xxhash64("place", "item", F.lit(seed))
    valued = turns.withColumns({"v1": half(1), "v2": half(2)})
    keyed = running_within(valued, "conv_id", ["place"], {"k1": ("xor", "v1"), "k2": ("xor", "v2")}, "prefixes")
    up = keyed.select("conv_id", "points", F.col("place").alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("v1")).alias("u1"), F.col("k2").bitwiseXOR(F.col("v2")).alias("u2"))
    nodes = written(up.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("points").alias("points"), F.max("u1").alias("u1"), F.max("u2").alias("u2")), "nodes")
    # all conversations are the root's
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", zero.alias("points"))
    top = nodes.where("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id"))))  # the root is one row
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(parents, ["depth", "u1", "u2"])
    columns = ["conv_id", "depth", "k1", "k2", "parent_conv_id", "n_convs", "points"]
    return written(top.select(columns).union(deep.select(columns)).union(root.select(columns)), "trie")


def _ends(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv_id, depth, k1, k2)`` of every conversation: the node it ends at."""
    half = lambda seed: F.bit_xor(F.xxhash64("place", "item", F.lit(seed)))
    last = turns.groupBy("conv_id").agg(half(1).alias("k1"), half(2).alias("k2"))
    nothing = F.lit(0).cast("long")
    return convs.join(last, "conv_id", "left").select("conv_id", F.col("turns").alias("depth"), F.coalesce("k1", nothing).alias("k1"), F.coalesce("k2", nothing).alias("k2"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)``: the hash of the ascending, comma-joined ids that end at a node.

    Ids are ranged by node and id and joined to pieces where they lie; a node's pieces, a few
    thousandths of its ids in number, go one after another through one hash, which SHA-256 asks for.
    """
    key = ["depth", "k1", "k2"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size, n = None, [], 0, 0
        out: list[tuple] = []
        for b in batches:
            for *node, conv in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if node != now or size > PIECE:
                    if ids:
                        out.append((*now, n, ",".join(ids)))
                        n += 1
                    now, ids, size = node, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
                if len(out) >= 4_096:
                    yield _rows(out)
                    out = []
        if ids:
            out.append((*now, n, ",".join(ids)))
        yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["depth", "k1", "k2", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            done = []
            for d, x, y, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (d, x, y) != now:
                    if h is not None:
                        done.append((*now, h.hexdigest()))
                    now, h = (d, x, y), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _digests(done)
        yield _digests([(*now, h.hexdigest())] if h is not None else [])

    def _digests(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in done], pa.int64()) for i in range(3)), pa.array([r[3] for r in done], pa.string())], ["depth", "k1", "k2", "ends_sha256"])

    ranged = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    cut = ranged.mapInArrow(pieces, "depth long, k1 long, k2 long, n long, ids string").withColumn("part", F.spark_partition_id())
    together = cut.repartition(*key).sortWithinPartitions(*key, "part", "n").select(*key, "ids")
    return together.mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def subtree_totals(tree: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """``(conv_id, depth, *values)`` summed over every node's subtree, itself included.

    ``tree`` has ``conv_id, depth`` (a node's name), ``up_conv, up_depth`` (its parent's; null at the
    root), ``kids`` and long ``values``; depths grow downwards. In every round each leaf gives its sum
    to its parent and goes, and a node with one child goes if the round's bit of its depth is set and
    its child isn't going: the child then hangs on the node's parent and carries what the node held.
    ``kids`` of other nodes stay. What is left is written after both steps.
    """
    extra = [f"add_{v}" for v in values]  # what a node hands to its parent besides its own subtree
    zero = F.lit(0).cast("long")
    names = ["conv_id", "depth", "up_conv", "up_depth", "kids", *values, *extra]
    state = written(tree.withColumns(dict.fromkeys(extra, zero)).select(names), "contracting")
    totals, links, rounds = [], [], 0
    bits = max(1, table_rows(state, F.max("depth")).bit_length())
    while True:
        going = (F.col("kids") == 1) & F.col("up_conv").isNotNull() & (F.shiftright("depth", rounds % bits) % 2 == 1)
        chains = state.where(going).select(*[F.col(c).alias(f"u_{c}") for c in names if c != "kids"])
        met = state.join(chains, (F.col("up_conv") == F.col("u_conv_id")) & (F.col("up_depth") == F.col("u_depth")), "left")
        over = F.col("u_conv_id").isNotNull() & ~F.coalesce(going, F.lit(False))
        moved = {"up_conv": F.when(over, F.col("u_up_conv")).otherwise(F.col("up_conv")), "up_depth": F.when(over, F.col("u_up_depth")).otherwise(F.col("up_depth"))}
        moved |= {a: F.when(over, F.col(a) + F.col(f"u_{v}") + F.col(f"u_{a}")).otherwise(F.col(a)) for v, a in zip(values, extra, strict=True)}
        held = {f"held_{v}": F.when(over, F.col(a) + F.col(f"u_{v}")) for v, a in zip(values, extra, strict=True)}
        gone = {"gone_conv": F.when(over, F.col("u_conv_id")), "gone_depth": F.when(over, F.col("u_depth"))}
        compressed = written(met.select("conv_id", "depth", "kids", *values, *[c.alias(n) for n, c in (moved | held | gone).items()]), "compressed")
        links.append(compressed.where("gone_conv is not null").select(F.col("gone_conv").alias("conv_id"), F.col("gone_depth").alias("depth"), F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), *[F.col(f"held_{v}").alias(v) for v in values]))
        leaves = compressed.where("kids = 0")
        totals.append(leaves.select("conv_id", "depth", *values))
        # what nodes hear of their children: sums of leaves, and that they are gone themselves
        heard = leaves.where("up_conv is not null").select(F.col("up_conv").alias("m_conv"), F.col("up_depth").alias("m_depth"), F.lit(1).cast("long").alias("m_kids"), F.lit(0).alias("m_gone"), *[(F.col(v) + F.col(a)).alias(f"m_{v}") for v, a in zip(values, extra, strict=True)])
        left = compressed.where("gone_conv is not null").select(F.col("gone_conv").alias("m_conv"), F.col("gone_depth").alias("m_depth"), zero.alias("m_kids"), F.lit(1).alias("m_gone"), *[zero.alias(f"m_{v}") for v in values])
        news = heard.union(left).groupBy("m_conv", "m_depth").agg(F.sum("m_kids").alias("m_kids"), F.max("m_gone").alias("m_gone"), *[F.sum(f"m_{v}").alias(f"m_{v}") for v in values])
        rest = compressed.where("kids > 0").join(news, (F.col("conv_id") == F.col("m_conv")) & (F.col("depth") == F.col("m_depth")), "left").where("coalesce(m_gone, 0) = 0")
        now = {"kids": F.col("kids") - F.coalesce("m_kids", zero)} | {v: F.col(v) + F.coalesce(f"m_{v}", zero) for v in values}
        after = written(rest.select(*[now[c].alias(c) if c in now else F.col(c) for c in names]), "contracting")
        discard(state)
        state, rounds = after, rounds + 1
        if not table_rows(state):
            break
    done = totals[0]
    for t in totals[1:]:
        done = done.union(t)
    ways = links[0]
    for way in links[1:]:
        ways = ways.union(way)
    ways = written(ways, "links")
    # a node compressed in one round points to one that went in a later round: at most ``rounds`` steps, halved by each doubling
    for _ in range((rounds - 1).bit_length()):
        step = ways.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("to_conv").alias("n_conv"), F.col("to_depth").alias("n_depth"), *[F.col(v).alias(f"n_{v}") for v in values])
        doubled = ways.join(step, ["to_conv", "to_depth"], "left").select(
            "conv_id", "depth", F.coalesce("n_conv", "to_conv").alias("to_conv"), F.coalesce("n_depth", "to_depth").alias("to_depth"), *[(F.col(v) + F.coalesce(f"n_{v}", zero)).alias(v) for v in values]
        )
        doubled = written(doubled, "links")
        discard(ways)
        ways = doubled
    ends = done.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), *[F.col(v).alias(f"n_{v}") for v in values])
    expanded = ways.join(ends, ["to_conv", "to_depth"]).select("conv_id", "depth", *[(F.col(v) + F.col(f"n_{v}")).alias(v) for v in values])
    return done.union(expanded)


def trie(talks: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations: who is in it, its parent and its subtree's totals.

    Null roles and texts are empty; turns come in order of ``turn``, null first, and those of equal turn
    in the order of a digest of role and text, so repeated rows are turns of their own. Rows without a
    ``conv_id`` are left out; a conversation whose turns are all dropped is a member of the root. No
    rows give no rows, not even a root. Columns of other names aren't read.
    """
    with passing() as made:
        turns, convs = rebuilt(talks)
        turns = written(turns, "rebuilt")
        nodes = _nodes(turns, convs)
        kids = nodes.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("k_conv"), (F.col("depth") - 1).alias("k_depth")).agg(F.count("*").alias("n_children"))
        nodes = nodes.join(kids, (F.col("conv_id") == F.col("k_conv")) & (F.col("depth") == F.col("k_depth")), "left").drop("k_conv", "k_depth").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        nodes = written(nodes.join(ends_digests(_ends(turns, convs)), ["depth", "k1", "k2"], "left").drop("k1", "k2"), "trie")
        tree = nodes.select(
            "conv_id", "depth", F.col("parent_conv_id").alias("up_conv"), F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("up_depth"), F.col("n_children").alias("kids"),
            (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"),
        )
        totals = subtree_totals(tree, ("n_leaves", "saved_tokens"))
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        out = nodes.join(totals, ["conv_id", "depth"])
        out = written(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")), "prefix-trie")
        made.pop()  # the result, which was written last
    return out



#: Every step is plain: prefixes as lists, ancestors through the smallest member.
TRIE_SQL = """
with recursive turns as (
  select conv_id, coalesce(role, '') r, coalesce(text, '') t, row_number() over (partition by conv_id order by turn nulls first, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) n
  from conversations where conv_id is not null),
crc as (select distinct conv_id, 4294967295::ubigint c, conv_id::varchar s, 0 k from conversations where conv_id is not null
  union all
  select conv_id, case when k % 9 = 0 then xor(c, ascii(s)::ubigint) when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end,
    case when k % 9 = 0 then substr(s, 2) else s end, k + 1
  from crc where not (k % 9 = 0 and s = '')),
convs as (select conv_id, xor(arg_max(c, k), 4294967295::ubigint)::bigint % 6 h from crc group by conv_id),
lists as (select c.conv_id, coalesce((select list(struct_pack(r, t) order by n) from turns where turns.conv_id = c.conv_id - c.conv_id % 100 and n <= h), [])
    || coalesce((select list(struct_pack(r, t) order by n) from turns where turns.conv_id = c.conv_id and n > h), []) l from convs c),
prefixes as (select conv_id, unnest(range(len(l) + 1)) d, l from lists),
placed as (select conv_id, d, len(l) total, l[1:d] p, min(conv_id) over (partition by d, l[1:d]) node from prefixes),
nodes as (select node, d, count(*) n_convs, max(case when d = 0 then 0 else length(p[d].t) end) points, string_agg(case when total = d then conv_id::varchar end, ',' order by conv_id) ends from placed group by node, d),
linked as (select n.*, p.node parent from nodes n left join placed p on p.conv_id = n.node and p.d = n.d - 1),
counted as (select l.*, (select count(*) from linked k where k.parent = l.node and k.d = l.d + 1) n_children from linked l),
sums as (select p.node, p.d, sum(case when n_children = 0 then 1 else 0 end) n_leaves, sum((n_convs - 1) * points) saved from counted c join placed p on p.conv_id = c.node and p.d <= c.d group by p.node, p.d)
select c.node conv_id, c.d depth, c.parent parent_conv_id, n_convs::bigint n_convs, n_children::bigint n_children, s.n_leaves::bigint n_leaves, s.saved::bigint saved_tokens, sha256(coalesce(ends, '')) ends_sha256
from counted c join sums s on s.node = c.node and s.d = c.d
"""
