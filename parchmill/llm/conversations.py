"""Problem 1: message rows -> ordered conversations.

Every message points at its parent: that of a column where the source has one (parent_col), otherwise the message
before it in its conversation; the first message points at the conversation itself. Pointer jumping
doubles the distance covered with each join, so a thread of n messages takes log2(n) rounds. What ends at
a node that doesn't exist is an orphan, what never ends is a cycle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import has_word

#: Spellings of the roles, after trimming and lower-casing.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "bot": "assistant", "system": "system"}

MESSAGE_COLUMNS = ("message_id", "conversation_id", "role", "content", "created_at", "ingested_at")


def canonical_role(role: Column) -> Column:
    """user, assistant or system; null for a missing or unknown role."""
    key = F.lower(F.regexp_replace(role, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    pairs = [F.lit(x) for kv in ROLES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def latest_messages(messages: DataFrame, parent_col: str | None = None) -> DataFrame:
    """Each message_id once, as last ingested (ties: the longer, then the greater content), role made canonical.

    Rows without message_id are kept once per distinct content; rows without conversation_id are dropped,
    as they belong to no conversation. Extra columns are ignored but parent_col, which becomes parent_id. max() combines on the map side, so a
    message delivered any number of times reaches the shuffle once per input partition.
    """
    given = [F.col(parent_col).cast("string").alias("parent_id")] if parent_col else []
    m = messages.select(*MESSAGE_COLUMNS, *given).filter(F.col("conversation_id").isNotNull())
    identity = F.coalesce("message_id", F.concat(F.lit("\u0000"), F.sha2(F.to_json(F.struct("conversation_id", "role", "content", "created_at")), 256)))
    pick = F.max(F.struct("ingested_at", F.length("content").alias("n"), "content", "created_at", "role", "conversation_id", *(["parent_id"] if given else []))).alias("m")
    return (
        m.groupBy(identity.alias("message_id")).agg(pick)
        .select("message_id", "m.conversation_id", canonical_role(F.col("m.role")).alias("role"), "m.content", "m.created_at", *(["m.parent_id"] if given else []))
    )


def _order() -> list[Column]:
    """By time; at the same instant the user first; then by id, so that the order is total."""
    return [F.col("created_at"), F.when(F.col("role") == "user", 0).otherwise(1), F.col("message_id")]


def previous_in_conversation(messages: DataFrame, payload: list[str]) -> DataFrame:
    """Add prev: a struct of payload from the message before in the same conversation, null for the first.

    A conversation may hold a third of all rows, so the rows are cut into ranges of (conversation, order);
    lag() runs inside a range and the first row of each range gets the last row of the one before.
    """
    o = _order()
    keyed = messages.withColumn("_o", F.struct(o[0].alias("t"), o[1].alias("r"), o[2].alias("i")))
    ranged = cut_lineage(keyed.repartitionByRange("conversation_id", "_o").withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy("conversation_id", "_range").orderBy("_o")
    item = F.struct(*payload)
    rows = ranged.withColumn("_lag", F.lag(item).over(inside))
    ends = ranged.groupBy("conversation_id", "_range").agg(F.max_by(item, F.col("_o")).alias("_last"))
    before = ends.withColumn("_before", F.lag("_last").over(W.partitionBy("conversation_id").orderBy("_range"))).select("conversation_id", "_range", "_before")
    return (
        rows.join(before.filter("_before is not null"), ["conversation_id", "_range"], "left")
        .withColumn("prev", F.coalesce("_lag", "_before"))
        .drop("_o", "_range", "_lag", "_before")
    )


def resolve_threads(nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pointer jumping. nodes(id, parent), roots(id) -> (id, root, depth, state) and the jump tables.

    state is "ok", "orphan" (the chain ends at an id that is neither node nor root, or at null) or "cycle".
    Jump table k maps a node to its ancestor 2^k steps up, as far as that is a node. ids of nodes must be
    unique and differ from those of roots. Nodes leave the loop as soon as they are resolved, so
    a root with many descendants isn't a hot join key; a hot parent is split by AQE's skew join.
    """
    start = (
        nodes.select("id", F.col("parent").alias("ptr"))
        .join(roots.select(F.col("id").alias("ptr"), F.lit(True).alias("at_root")).distinct(), "ptr", "left")
        .join(nodes.select(F.col("id").alias("ptr"), F.lit(True).alias("at_node")), "ptr", "left")
        .select("id", "ptr", F.lit(1).cast("long").alias("dist"), F.when(F.col("at_root"), "ok").when(F.col("at_node"), None).otherwise("orphan").alias("state"))
    )
    start = cut_lineage(start)
    current, done, jumps, n = start, [], [], None
    for _ in range(64):
        done.append(current.filter("state is not null"))
        open_ = current.filter("state is null")
        left = open_.count()
        if n is None:
            n, limit = left, math.ceil(math.log2(max(left, 2))) + 2
        if not left or limit <= 0:
            break
        limit -= 1
        jumps.append(open_.select("id", "ptr"))
        known = done[0].unionByName(current.filter("state is null")) if len(done) == 1 else _union([*done, open_])
        step = known.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("state").alias("state2"))
        current = cut_lineage(
            open_.join(step, "ptr").select("id", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("state2").alias("state"))
        )
    unresolved = current.filter("state is null").withColumn("state", F.lit("cycle"))
    resolved = _union([*done, unresolved]).select(
        "id", F.when(F.col("state") == "ok", F.col("ptr")).alias("root"), F.when(F.col("state") == "ok", F.col("dist")).alias("depth"), "state"
    )
    return resolved, jumps


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def root_to_leaf_paths(nodes: DataFrame, resolved: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(root, leaf, id, position), position 1 next to the root: each leaf with all its ancestors.

    The ancestors of a leaf at distances 0..2^k-1, jumped by table k, give those up to 2^(k+1)-1.
    """
    ok = resolved.filter("state = 'ok'")
    parents = nodes.join(ok.select("id"), "id", "left_semi").select(F.col("parent").alias("id")).distinct()
    paths = ok.join(parents, "id", "left_anti").select("root", F.col("id").alias("leaf"), "id", F.col("depth").alias("position"))
    for k, jump in enumerate(jumps):
        up = paths.filter(F.col("position") > 2**k).join(jump, "id")
        # Written each round: the plan would double with every round else.
        paths = cut_lineage(paths.unionByName(up.select("root", "leaf", F.col("ptr").alias("id"), (F.col("position") - 2**k).alias("position"))))
    return paths


def _past_system(latest: DataFrame) -> DataFrame:
    """parent_id of each message, but of system messages the nearest ancestor that is none: by pointer jumping over system messages alone."""
    system = cut_lineage(latest.filter("role = 'system'").select(F.col("message_id").alias("sid"), F.col("parent_id").alias("up")))
    for _ in range(64):
        above = system.select(F.col("sid").alias("up"), F.col("up").alias("up2"), F.lit(True).alias("hit"))
        step = cut_lineage(system.join(above, "up", "left").select("sid", "up", "up2", F.coalesce("hit", F.lit(False)).alias("hit")))
        if not step.filter("hit").take(1):
            break
        system = step.select("sid", F.when(F.col("hit"), F.nullif(F.col("up2"), F.col("sid"))).otherwise(F.col("up")).alias("up"))
    over = system.select(F.col("sid").alias("parent_id"), "up", F.lit(True).alias("over"))
    return latest.join(over, "parent_id", "left").withColumn("parent_id", F.when(F.col("over"), F.col("up")).otherwise(F.col("parent_id"))).drop("up", "over")


def conversation_nodes(latest: DataFrame) -> DataFrame:
    """(id, parent, conversation_id, role, content, created_at, message_id) of all messages but the system's.

    Ids are prefixed, as a message and a conversation may bear the same id. A message without recognisable role, or without both
    time and given parents, can't be placed: its parent is null, which makes it an orphan. Where parents are given (parent_id), null stands for the
    conversation, and children of a system message are children of its parent.
    """
    columns = ["conversation_id", "role", "content", "created_at", "message_id"]
    root, node = F.concat(F.lit("c:"), F.col("conversation_id")), F.concat(F.lit("m:"), F.col("message_id")).alias("id")
    no_system = F.coalesce(F.col("role") != "system", F.lit(True))
    if "parent_id" in latest.columns:
        told = _past_system(latest).filter(no_system)
        parent = F.when(F.col("role").isNotNull(), F.coalesce(F.concat(F.lit("m:"), F.col("parent_id")), root))
        return cut_lineage(told.select(node, parent.alias("parent"), *columns))
    told = latest.filter(no_system)
    prev = previous_in_conversation(told.filter("created_at is not null and role is not null"), ["message_id"])
    a = prev.select(node, F.coalesce(F.concat(F.lit("m:"), F.col("prev.message_id")), root).alias("parent"), *columns)
    b = told.filter("created_at is null or role is null").select(node, F.lit(None).cast("string").alias("parent"), *columns)
    return cut_lineage(a.unionByName(b))


def _judged(messages: DataFrame, conversations: DataFrame, parent_col: str | None) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    nodes = conversation_nodes(latest_messages(messages, parent_col))
    known = conversations.filter("conversation_id is not null").select("conversation_id").distinct()
    roots = known.select(F.concat(F.lit("c:"), F.col("conversation_id")).alias("id"))
    links = nodes.select("id", "parent")
    resolved, jumps = resolve_threads(links, roots)
    if parent_col:  # a thread that leads into another conversation is lost to its own
        own = nodes.select("id", F.concat(F.lit("c:"), F.col("conversation_id")).alias("own"))
        state = F.when((F.col("state") == "ok") & (F.col("root") != F.col("own")), "orphan").otherwise(F.col("state"))
        resolved = resolved.join(own, "id").select("id", "root", "depth", state.alias("state"))
    resolved = cut_lineage(resolved)
    flags = nodes.select("id", "conversation_id", "role", (~has_word(F.col("content"))).alias("blank"))
    inner = links.join(resolved.filter("state = 'ok'").select("id"), "id", "left_semi") if parent_col else links
    inner = inner.filter("parent like 'm:%'").select(F.col("parent").alias("id"), F.lit(True).alias("inner")).distinct()
    placed = flags.join(resolved, "id").join(inner, "id", "left")
    ok = F.col("state") == "ok"
    leaf = ok & F.col("inner").isNull()
    # In an alternation that begins with the user the parity of the depth tells the role.
    expected = F.when(F.col("depth") % 2 == 1, "user").otherwise("assistant")
    counts = placed.groupBy("conversation_id").agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("lost"), F.count_if(ok & F.col("blank")).alias("blank"), F.count_if(ok & (F.col("role") != expected)).alias("misplaced"),
        F.count_if(leaf).alias("leaves"), F.count_if(leaf & (F.col("depth") % 2 == 1)).alias("open"),
    )
    # A conversation of system messages alone has no node, but is listed all the same.
    ids = known.withColumn("known", F.lit(True)).unionByName(messages.filter("conversation_id is not null").select("conversation_id").distinct().withColumn("known", F.lit(False)))
    ids = ids.groupBy("conversation_id").agg(F.bool_or("known").alias("known"))
    reason = (
        F.when(~F.col("known"), "unknown_conversation")
        .when(F.coalesce("lost", F.lit(0)) > 0, "unplaced_message")
        .when(F.coalesce("n", F.lit(0)) == 0, "no_messages")
        .when(F.col("blank") > 0, "blank_content")
        .when((F.col("misplaced") > 0) & (F.col("leaves") == 1), "not_alternating")
        .when((F.col("open") > 0) | (F.col("misplaced") > 0), "no_reply")
    )
    judged = ids.join(counts, "conversation_id", "left").select("conversation_id", reason.isNull().alias("usable"), reason.alias("reason"))
    return judged, nodes, resolved, jumps


def judge_conversations(messages: DataFrame, conversations: DataFrame, parent_col: str | None = None) -> DataFrame:
    """(conversation_id, usable, reason), one row per id of either table.

    reason is the first of unknown_conversation, no_messages, unplaced_message, blank_content, not_alternating, no_reply that applies. Every message of a
    resolved thread is on a path from the root to a leaf, so that depths and leaves tell what paths would; none is emitted.
    Null conversation ids are no conversations; repeated rows of conversations count once.
    """
    return _judged(messages, conversations, parent_col)[0]


def thread_conversations(messages: DataFrame, conversations: DataFrame, parent_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """judge_conversations, and the messages on their root-to-leaf paths.

    Second frame: (conversation_id, leaf, position, message_id, role, created_at, content); with branches a message is on several paths.
    """
    judged, nodes, resolved, jumps = _judged(messages, conversations, parent_col)
    paths = root_to_leaf_paths(nodes.select("id", "parent"), resolved, jumps)
    return judged, paths.join(nodes, "id").select("conversation_id", "leaf", "position", "message_id", "role", "created_at", "content")


def rebuild_conversations(messages: DataFrame, conversations: DataFrame, parent_col: str | None = None) -> DataFrame:
    """Usable conversations only: (conversation_id, position, message_id, role, created_at, content), a row per message, and leaf where parents are
    given: each leaf is the end of a conversation of its own.

    A row per message, not an array per conversation: no row grows with the longest conversation.
    """
    judged, talk = thread_conversations(messages, conversations, parent_col)
    kept = talk.join(judged.filter("usable").select("conversation_id"), "conversation_id")
    return kept.withColumn("leaf", F.substring("leaf", 3, 2**31 - 1)) if parent_col else kept.drop("leaf")


def answer_pairs(latest: DataFrame) -> DataFrame:
    """(conversation_id, message_id, answer, question): assistant messages directly after a user message."""
    told = latest.filter(F.coalesce(F.col("role") != "system", F.lit(True)) & F.col("created_at").isNotNull())
    prev = previous_in_conversation(told, ["role", "content"])
    return prev.filter("role = 'assistant' and prev.role = 'user'").select("conversation_id", "message_id", F.col("content").alias("answer"), F.col("prev.content").alias("question"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Conversations that are not usable."""
    judged = judge_conversations(spark.read.parquet(f"{sf_dir}/chat_messages.parquet"), spark.read.parquet(f"{sf_dir}/chat_conversations.parquet"))
    return judged.filter("not usable").select("conversation_id")


def p1_conversations(spark, sf_dir: str) -> DataFrame:
    """The usable conversations, message by message; created_us in microseconds since 1970."""
    talk = rebuild_conversations(spark.read.parquet(f"{sf_dir}/chat_messages.parquet"), spark.read.parquet(f"{sf_dir}/chat_conversations.parquet"))
    return talk.withColumn("created_at", F.unix_micros("created_at")).withColumnRenamed("created_at", "created_us")


QUERIES = {"p1_found": p1_found, "p1_conversations": p1_conversations}

_LAST = """
with roles(spelling, kind) as (values ('user','user'),('human','user'),('assistant','assistant'),('model','assistant'),('bot','assistant'),('system','system')),
last as (
  select message_id, conversation_id, lower(trim(role)) as spelling, content, created_at from chat_messages where conversation_id is not null
  qualify row_number() over (partition by message_id order by ingested_at desc, length(content) desc, content desc) = 1),
told as (
  select l.*, r.kind, row_number() over (partition by conversation_id order by created_at, case when r.kind = 'user' then 0 else 1 end, message_id) as pos
  from last l left join roles r using (spelling) where r.kind is null or r.kind <> 'system'),
ids as (select conversation_id from chat_conversations where conversation_id is not null union select conversation_id from chat_messages where conversation_id is not null),
judged as (
  select i.conversation_id, i.conversation_id in (select conversation_id from chat_conversations) and count(t.message_id) > 0 and count(t.message_id) % 2 = 0
    and coalesce(bool_and(t.created_at is not null and t.kind is not null and coalesce(regexp_matches(t.content, '[\\p{L}\\p{N}]'), false)
    and (case when pos % 2 = 1 then 'user' else 'assistant' end) = t.kind), false) as usable
  from ids i left join told t using (conversation_id) group by i.conversation_id)
"""
SQL = {
    "p1_found": _LAST + "select conversation_id from judged where not usable",
    "p1_conversations": _LAST + "select t.conversation_id, pos as position, message_id, kind as role, epoch_us(t.created_at) as created_us, content from told t join judged j using (conversation_id) where j.usable",
}
