"""Conversation sessions: folding messages into state, summaries, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def fold_sessions(messages: DataFrame, session: str, seq: str, role: str = "role", text: str = "text") -> DataFrame:
    """(session_id, title, history, n_messages): history ordered by ``seq``; the title
    is the first user message, clipped to 60 characters."""
    m = F.struct(F.col(seq).alias("seq"), F.col(role).alias("role"), X.text_of(F.col(text)).alias("content"))
    g = messages.groupBy(F.col(session).alias("session_id")).agg(F.array_sort(F.collect_list(m)).alias("history"))
    return g.select("session_id", title(F.col("history")).alias("title"), "history", F.size("history").alias("n_messages"))


#: Fixed value: the title of a session in which no user has said anything.
UNTITLED = "Cuộc hội thoại mới"


def title(history: Column) -> Column:
    """The first user message that says anything, at most 60 characters of it."""
    strip = lambda c: F.regexp_replace(X.text_of(c), r"(?U)^\s+|\s+\z", "")
    said = F.get(F.filter(F.transform(F.filter(history, lambda m: m["role"] == "user"), lambda m: strip(m["content"])), lambda t: t != ""), 0)
    return F.when(said.isNull(), UNTITLED).when(F.length(said) > 60, F.concat(F.substring(said, 1, 60), F.lit("..."))).otherwise(said)


def recent(history: Column, n: int = 6) -> Column:
    size = F.least(F.size(history), F.lit(n))
    return F.when(size == 0, F.slice(history, 1, 0)).otherwise(F.slice(history, F.size(history) - size + 1, size))


def recent_text(history: Column, n: int = 6) -> Column:
    lines = F.transform(recent(history, n), lambda m: F.when(X.squeeze(m["content"]) != "", F.concat(m["role"], F.lit(": "), X.squeeze(m["content"]))))
    return F.array_join(lines, "\n")


def case_state(summary: Column, facts: Column, follow_up: Column) -> Column:
    """The state of a case as text: summary, facts by name, open question."""
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce(facts, F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", X.falsy_coalesce(summary), F.nullif(F.array_join(entries, "\n"), F.lit("")), X.falsy_coalesce(follow_up))


def visible(sessions: DataFrame) -> DataFrame:
    """What a list of sessions shows: none that is archived."""
    return sessions.where(~F.coalesce(F.col("archived"), F.lit(False)))


def sorted_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("pinned"), F.desc("updated_at"), F.asc("session_id"))


def message_times(history: Column, base: Column) -> Column:
    """Message i is i minutes after ``base``."""
    return F.transform(history, lambda m, i: base + F.make_dt_interval(mins=i))


def citation_warnings(answer: Column, source_numbers: Column) -> Column:
    """A warning for each document number that an answer names and no source has, in
    order of the numbers, which are compared without case and white space."""
    plain = lambda c: F.regexp_replace(X.casefold(c), r"(?U)\s+", "")
    named = F.transform(F.regexp_extract_all(X.text_of(answer), F.lit(X.CITED_NUMBER), F.lit(0)), plain)
    missing = F.array_sort(F.array_except(named, F.transform(F.coalesce(source_numbers, F.array().cast("array<string>")), plain)))
    return F.transform(missing, lambda n: F.concat(F.lit("Answer cites a document not present in retrieved sources: "), n))


# --- keyed changes and what an API shows ----------------------------------------

SESSION = (
    "session_id string, title string, history array<struct<id:string,role:string,content:string,timestamp:string>>, facts map<string,string>, case_summary string, "
    "pending_follow_up string, last_retrieval_query string, archived boolean, pinned boolean, updated_at string"
)


def with_defaults(sessions: DataFrame) -> DataFrame:
    """Sessions with every field: what is missing is empty, false or none."""
    kinds = T._parse_datatype_string(SESSION)
    empty = {"title": F.lit(""), "case_summary": F.lit(""), "last_retrieval_query": F.lit(""), "archived": F.lit(False), "pinned": F.lit(False), "facts": F.create_map().cast("map<string,string>")}

    def one(f: T.StructField) -> Column:
        value = F.col(f.name).cast(f.dataType) if f.name in sessions.columns else F.lit(None).cast(f.dataType)
        if f.name == "history":
            return F.coalesce(value, F.array().cast(f.dataType)).alias(f.name)
        return (F.coalesce(value, empty[f.name]) if f.name in empty else value).alias(f.name)

    return sessions.select(*map(one, kinds))


def appended(sessions: DataFrame, messages: DataFrame, seq: str = "seq") -> DataFrame:
    """Sessions with messages (session_id, role, content, timestamp, seq) at the end of
    their history, and touched by the last; sessions that are new begin so."""
    m = F.struct(F.col(seq).alias("s"), F.lit(None).cast("string").alias("id"), "role", X.text_of(F.col("content")).alias("content"), F.col("timestamp").cast("string").alias("timestamp"))
    new = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(m)).alias("__m"))
    said = F.transform("__m", lambda x: F.struct(x["id"].alias("id"), x["role"].alias("role"), x["content"].alias("content"), x["timestamp"].alias("timestamp")))
    j = with_defaults(with_defaults(sessions).join(new.select("session_id"), "session_id", "full").select("session_id", *[c for c in with_defaults(sessions).columns if c != "session_id"])).join(new, "session_id", "left")
    j = j.withColumn("updated_at", F.coalesce(F.element_at("__m", -1)["timestamp"], F.col("updated_at")))
    return j.withColumn("history", F.concat("history", F.coalesce(said, F.array().cast(dict(j.dtypes)["history"])))).drop("__m")


def patched(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions with new titles (120 characters at most; an empty one is refused), pins
    and archive marks, where ``changes`` (session_id, title, pinned, archived) have
    any. The time of change stays."""
    c = changes.select("session_id", F.trim("title").alias("__t"), F.col("pinned").alias("__p"), F.col("archived").alias("__a"))
    j = sessions.join(c, "session_id", "left")
    bad = F.raise_error(F.lit("a title cannot be empty")).cast("string")
    name = F.when(F.col("__t") == "", bad).when(F.col("__t").isNotNull(), F.substring("__t", 1, 120)).otherwise(F.col("title"))
    return j.withColumns({"title": name, "pinned": F.coalesce("__p", "pinned"), "archived": F.coalesce("__a", "archived")}).drop("__t", "__p", "__a")


def summaries(sessions: DataFrame) -> DataFrame:
    """What a list shows of the sessions in which something was said."""
    own = F.trim(X.text_of(F.col("title")))
    strip = lambda c: F.regexp_replace(X.text_of(c), r"(?U)^\s+|\s+\z", "")
    said = F.get(F.filter("history", lambda m: m["role"] == "user"), 0)["content"]
    return sessions.where(F.size("history") > 0).select(
        "session_id", F.when(own != "", own).otherwise(title(F.col("history"))).alias("title"), "updated_at", F.size("history").alias("message_count"), strip(said).alias("preview"),
        F.coalesce("archived", F.lit(False)).alias("archived"), F.coalesce("pinned", F.lit(False)).alias("pinned"),
    )


def conversation(sessions: DataFrame, changed: Column) -> DataFrame:
    """(session_id, position, id, role, content, timestamp): messages without a time
    are a minute apart, the last at the session's change."""
    base = changed - F.make_dt_interval(mins=F.greatest(F.size("history") - 1, F.lit(0)))
    x = sessions.select("session_id", base.alias("__base"), F.posexplode("history").alias("position", "m"))
    time = F.coalesce(F.try_to_timestamp(F.regexp_replace(F.col("m.timestamp"), "Z$", "+00:00")), F.col("__base") + F.make_dt_interval(mins=F.col("position")))
    made = F.concat(F.lit("msg-"), F.substring(F.sha2(F.concat_ws(":", "session_id", "position"), 256), 1, 12))
    return x.select("session_id", "position", X.falsy_coalesce(F.col("m.id"), made).alias("id"), X.falsy_coalesce(F.col("m.role"), F.lit("assistant")).alias("role"), X.text_of(F.col("m.content")).alias("content"), time.alias("timestamp"))


def memory(answer: Column) -> Column:
    """A model's account of a case, out of the JSON in its answer; what is missing or
    of another kind is empty."""
    v = X.json_object(answer)
    text = lambda name: F.trim(X.text_of(F.try_variant_get(v, f"$.{name}", "string")))
    return F.struct(
        text("case_summary").alias("case_summary"), F.coalesce(F.try_variant_get(v, "$.facts", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("facts"),
        F.coalesce(F.try_variant_get(v, "$.need_clarification", "boolean"), F.lit(False)).alias("need_clarification"),
        F.filter(F.coalesce(F.try_variant_get(v, "$.missing_fields", "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x) != "").alias("missing_fields"),
        text("follow_up_question").alias("follow_up_question"), text("retrieval_query").alias("retrieval_query"),
    )
