"""Documents' states, duplicates, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(chunks: DataFrame) -> DataFrame:
    """doc_id, content_hash: SHA-256 over a document's chunk texts in order, each after its length in 8 bytes (DUP1)."""
    ordered = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    whole = F.expr("aggregate(transform(c, x -> x.text), cast('' as binary), (a, x) -> concat(a, unhex(lpad(hex(octet_length(x)), 16, '0')), encode(x, 'UTF-8')))")
    return ordered.select("doc_id", F.sha2(whole, 256).alias("content_hash"))


def batch_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, duplicate_of: the first upload of each content stays, the others point to it (DUP3). docs: doc_id, content_hash, uploaded_at."""
    first = docs.groupBy("content_hash").agg(F.min_by("doc_id", F.struct("uploaded_at", "doc_id")).alias("first"))
    return docs.join(first, "content_hash").select("doc_id", F.when(F.col("doc_id") != F.col("first"), F.col("first")).alias("duplicate_of"))


def current_state(events: DataFrame) -> DataFrame:
    """doc_id, state, error_reason: the latest; a reason only while failed (LIF2). events: doc_id, seq, state, reason."""
    last = events.groupBy("doc_id").agg(F.max_by(F.struct("state", "reason"), "seq").alias("x"))
    return last.select("doc_id", "x.state", F.when(F.col("x.state") == "failed", F.col("x.reason")).alias("error_reason"))


def next_turn_index(turns: DataFrame) -> DataFrame:
    """conv_id, next_index (CNV4)."""
    return turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("next_index"))


def recent_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, numbered from the oldest of them (CNV1)."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return last.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("back")


def history(turns: DataFrame, n: int = 6) -> DataFrame:
    """conv_id, history: roles and texts of the last n turns, oldest first (CNV2)."""
    rows = recent_turns(turns, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    return rows.select("conv_id", F.array_join(F.transform("h", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))


def question_history(turns: DataFrame, n: int = 10) -> DataFrame:
    """conv_id, questions: the last n of the user, oldest first (CNV3)."""
    rows = recent_turns(turns.where("role = 'user'"), n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("h"))
    return rows.select("conv_id", F.transform("h", lambda x: x["text"]).alias("questions"))


def preview(text: Column, longest: int = 72) -> Column:
    """White space as single spaces; longer than `longest` is cut at the last space with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    head = F.substring(t, 1, longest)
    at_space = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(t) <= longest, t).otherwise(F.concat(at_space, F.lit("…")))


def conversation_list(turns: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """conv_id, last_turn, turns, preview, latest first (CNV5). turns: conv_id, turn, role, text, at."""
    g = turns.groupBy("conv_id").agg(F.max("at").alias("last_activity"), F.count("*").alias("turns"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("t"))
    return g.select("conv_id", "last_activity", "turns", preview(F.coalesce("t", F.lit(""))).alias("preview")).orderBy(F.col("last_activity").desc(), "conv_id").offset(offset).limit(limit)


def conversation_detail(turns: DataFrame) -> DataFrame:
    """conv_id, detail: all turns, oldest first (CNV6)."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("detail"))


def without_conversations(turns: DataFrame, deleted: DataFrame) -> DataFrame:
    """Turns of conversations that are not deleted; query logs are kept as they are (CNV7)."""
    return turns.join(deleted.select("conv_id"), "conv_id", "left_anti")


def verdicts(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """doc_id, verdict, existing (DUP2): a document's own row first, then a live copy, the newest. incoming: doc_id, content_hash; registry also state, uploaded_at."""
    r = registry.select("content_hash", F.col("doc_id").alias("other"), "state", "uploaded_at")
    j = incoming.select("doc_id", "content_hash").join(r, "content_hash", "left")
    best = j.groupBy("doc_id").agg(F.max_by(F.struct("other", "state"), F.struct(F.col("other") == F.col("doc_id"), F.col("state") == "live", "uploaded_at", "other")).alias("x"))
    own, live = F.col("x.other") == F.col("doc_id"), F.col("x.state") == "live"
    v = F.when(own & live, "same_document").when(own, "newer_version").when(live, "duplicate").otherwise("new")
    return best.select("doc_id", v.alias("verdict"), F.when(v != "new", F.col("x.other")).alias("existing"))


#: The states that may follow each state.
TRANSITIONS = {
    "pending": ["extracting", "failed"],
    "extracting": ["chunking", "duplicate", "failed"],
    "chunking": ["embedding", "duplicate", "failed"],
    "embedding": ["indexing", "failed"],
    "indexing": ["live", "failed"],
    "duplicate": ["pending", "deleted"],
    "live": ["superseded", "disabled", "deleted", "failed"],
    "failed": ["pending", "deleted"],
    "superseded": ["deleted"],
    "disabled": ["live", "deleted"],
    "deleted": [],
}


def legal(source: Column, target: Column) -> Column:
    pairs = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    return F.concat(source, F.lit(">"), target).isin(pairs)


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events that may not follow the one before, or fail without a reason (LIF1). events: doc_id, seq, state, reason."""
    before = F.lag("state").over(Window.partitionBy("doc_id").orderBy("seq"))
    e = events.withColumn("before", before)
    bad = ~F.coalesce(legal(F.col("before"), F.col("state")), F.col("state") == "pending") | ((F.col("state") == "failed") & (F.coalesce("reason", F.lit("")) == ""))
    return e.where(bad).select("doc_id", "seq", "before", "state")


def after_actions(registry: DataFrame, actions: DataFrame) -> DataFrame:
    """doc_id, state, successor: admin actions folded in order; ones that do not apply change nothing (LIF4). actions: doc_id, seq, action, successor."""
    a = actions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "successor"))).alias("acts"))
    step = """case when x.action = 'disable' and s.state = 'live' then named_struct('state', 'disabled', 'successor', s.successor)
        when x.action = 'enable' and s.state = 'disabled' then named_struct('state', 'live', 'successor', s.successor)
        when x.action = 'supersede' and s.state = 'live' then named_struct('state', 'superseded', 'successor', if(x.successor <> doc_id, x.successor, s.successor))
        when x.action = 'delete' and s.state in ('live', 'disabled', 'superseded', 'failed', 'duplicate') then named_struct('state', 'deleted', 'successor', s.successor) else s end"""
    fold = f"aggregate(coalesce(acts, array()), named_struct('state', state, 'successor', cast(null as {dict(actions.dtypes)['successor']})), (s, x) -> {step})"
    return registry.select("doc_id", "state").join(a, "doc_id", "left").select("doc_id", F.expr(fold).alias("r")).select("doc_id", "r.state", "r.successor")


def without_failed(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks of documents that did not fail (LIF5); also the form of an index purge (KW7)."""
    return chunks.join(registry.where("state = 'failed'").select("doc_id"), "doc_id", "left_anti")


def invariants(docs: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """rule, violations (LIF7). docs: doc_id, text, state; chunks: chunk_id, doc_id, char_start, char_end, text, embedding."""
    j = chunks.join(docs.select("doc_id", F.col("text").alias("whole"), "state"), "doc_id")
    cut = F.expr("substring(whole, char_start + 1, char_end - char_start)")
    live = F.col("state") == "live"
    n = j.agg(
        F.count_if(cut != F.col("text")).alias("a"), F.count_if((F.col("char_start") < 0) | (F.col("char_end") > F.length("whole")) | (F.col("char_start") >= F.col("char_end"))).alias("b"),
        F.count_if(live & F.col("embedding").isNull()).alias("c"), F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") != width)).alias("d"),
    )
    bare = docs.where("state = 'live'").join(chunks.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("e"))
    names = {"a": "offset mismatch", "b": "offset out of range", "c": "missing vector", "d": "vector width", "e": "live without chunks"}
    rows = F.array(*[F.struct(F.lit(v).alias("rule"), F.col(k).alias("violations")) for k, v in names.items()])
    return n.crossJoin(bare).select(F.explode(rows).alias("r")).select("r.*")  # one row each
