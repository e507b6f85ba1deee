"""Chat formatting by schema fingerprints. DataFrame functions only.

Records of unlike layouts (rows by turn, prompt and completion, instruction with input and output, message lists) are
VARIANT values. The paths of a record's fields, two levels deep through lists, are walked; those that some layout names are
sorted and hashed, which is the record's fingerprint, so further fields (ids, names, scores) don't change it. The
fingerprint selects a declarative mapping, which says where the canonical turns ``(role, text)`` are. Adding a layout is
adding an entry to ``LAYOUTS``, not code.

The template writes a turn as ``### role\\n text </turn>\\n``. Inside roles and texts the three characters that control
strings and escapes need are escaped, so no text can open or close a turn, and the writing is reversible:
``\\`` is written ``\\b``, ``<`` is ``\\l``, ``#`` is ``\\h``; in roles a line feed is ``\\n`` also.

Roles are written as the record gives them; only layouts that name speakers in ways of their own (``from``, ``speaker``)
have them translated, as their mapping says.

Defined results: a null text or role is empty; rows of a null conversation are one conversation; rows with equal turns
are ordered by role, then text, null turns first; repeated rows are turns of their own; a record whose fingerprint no layout
has gets the mapping ``unknown`` and no turns, and a conversation without turns is kept, with a null ``formatted``; empty
tables give empty tables; other columns, whatever their names, are not read. One conversation is one output row, so its text
is put together in one task, as any operator that returns it whole must; what is shuffled is the rows' own texts, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END = "</turn>"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]

#: Field paths of a layout, and where its turns are: (role or path of the role, path of the text).
LAYOUTS: dict[str, dict] = {
    "turn": {"paths": ["role", "text"], "turns": [("$.role", "$.text")]},
    "prompt_completion": {"paths": ["completion", "prompt"], "turns": [("user", "$.prompt"), ("assistant", "$.completion")]},
    "prompt_response": {"paths": ["prompt", "response"], "turns": [("user", "$.prompt"), ("assistant", "$.response")]},
    "system_prompt_response": {"paths": ["prompt", "response", "system"], "turns": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")]},
    "instruction": {"paths": ["instruction", "output"], "turns": [("user", "$.instruction"), ("assistant", "$.output")]},
    "instruction_input": {"paths": ["input", "instruction", "output"], "turns": [("user", ("$.instruction", "$.input")), ("assistant", "$.output")]},
    "question_answer": {"paths": ["answer", "question"], "turns": [("user", "$.question"), ("assistant", "$.answer")]},
    "messages": {"paths": ["messages[].content", "messages[].role"], "list": ("$.messages", "role", "content")},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "list": ("$.conversations", "from", "value"), "speakers": True},
    "dialog": {"paths": ["dialog[].speaker", "dialog[].text"], "list": ("$.dialog", "speaker", "text"), "speakers": True},
}
#: All paths that layouts name.
KNOWN = sorted({p for spec in LAYOUTS.values() for p in spec["paths"]})
#: Speakers' names and their canonical roles; others stay as they are.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _keys(value: Column) -> Column:
    """Field names of a VARIANT object; of anything else none."""
    return F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))


def path_list(record: Column) -> Column:
    """Sorted field paths of a VARIANT object, ``a[].b`` for the fields of a list's objects, whichever of them has one."""

    def under(name: Column) -> Column:
        items = F.try_variant_get(record, F.concat(F.lit("$."), name), "array<variant>")
        inner = F.array_distinct(F.flatten(F.transform(items, _keys)))
        return F.when(name.rlike(r"^\w+$") & items.isNotNull() & (F.size(inner) > 0), F.transform(inner, lambda x: F.concat(name, F.lit("[]."), x))).otherwise(F.array(name))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(_keys(record), under))))


def fingerprint(paths: Column) -> Column:
    """Of the paths that layouts know."""
    return F.xxhash64(F.concat_ws("\n", F.filter(paths, lambda p: p.isin(*KNOWN))))


def _layout_map() -> Column:
    return F.create_map(*[x for name, spec in LAYOUTS.items() for x in (fingerprint(F.array(*map(F.lit, sorted(spec["paths"])))), F.lit(name))])


def _get(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _speaker(name: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    return F.coalesce(F.element_at(named, F.lower(name)), name)


def _turn(role: Column, text: Column, speakers: bool) -> Column:
    role = F.coalesce(role, F.lit(""))
    return F.struct((_speaker(role) if speakers else role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _item(who: str, what: str, speakers: bool):
    return lambda x: _turn(x[who], x[what], speakers)


def canonical_turns(records: DataFrame, record: str) -> DataFrame:
    """Adds fingerprint, layout and turns (array of role, text; null for an unknown layout) for a VARIANT column."""
    v = F.col(record)
    out = records.withColumn("fingerprint", fingerprint(path_list(v)))
    out = out.withColumn("layout", F.coalesce(F.element_at(_layout_map(), F.col("fingerprint")), F.lit("unknown")))
    turns = F.lit(None)
    for name, spec in LAYOUTS.items():
        speakers = spec.get("speakers", False)
        if "list" in spec:
            path, who, what = spec["list"]
            items = F.try_variant_get(v, path, f"array<struct<{who}:string,{what}:string>>")
            made = F.transform(items, _item(who, what, speakers))
        else:
            each = []
            for who, what in spec["turns"]:
                text = _get(v, what) if isinstance(what, str) else F.concat_ws("\n\n", *[F.nullif(_get(v, p), F.lit("")) for p in what])
                each.append(_turn(_get(v, who) if who.startswith("$") else F.lit(who), text, speakers))
            made = F.array(*each)
        turns = F.when(F.col("layout") == name, made).otherwise(turns)
    return out.withColumn("turns", turns)


def escaped(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Each backslash of an escaped text starts a code, so the codes can be undone one after the other, its own last."""
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def written(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escaped(text), F.lit(END + "\n"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: role and text, unescaped."""
    parts = F.filter(F.split(formatted, END + "\n"), lambda x: x != "")
    head = lambda x: F.substring(F.substring_index(x, "\n", 1), F.lit(5), F.length(x))
    body = lambda x: F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))
    return F.transform(parts, lambda x: F.struct(unescaped(F.replace(head(x), F.lit("\\n"), F.lit("\n"))).alias("role"), unescaped(body(x)).alias("text")))


def format_records(records: DataFrame, record: str = "record", conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """VARIANT records of any layouts, also of several in one conversation, in the order of ``turn``, to one row per
    conversation: conv, n_unknown (records of no known layout), formatted (null without turns), loss_spans (start and end, in
    characters of ``formatted``, of each assistant text as written there)."""
    plain = records.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(record).alias("record"))
    found = canonical_turns(plain, "record").select("conv", "turn", "turns")
    own = F.when(F.col("turns").isNotNull(), F.struct("turn", "turns"))
    gathered = found.groupBy("conv").agg(F.array_sort(F.collect_list(own)).alias("parts"), F.count_if(F.col("turns").isNull()).alias("n_unknown"))
    turns = F.flatten(F.transform("parts", lambda x: x["turns"]))
    gathered = gathered.select("conv", "n_unknown", F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), written(t["role"], t["text"]).alias("out"))).alias("items"))
    ends = F.aggregate(
        "items", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["out"])).alias("at"),
            F.when(x["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.length(x["out"]) - len(END) - 1 - F.length(escaped(x["text"]))).alias("start"), (s["at"] + F.length(x["out"]) - len(END) - 1).alias("end"),
            )))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    whole = F.when(F.size("items") > 0, F.array_join(F.transform("items", lambda x: x["out"]), ""))
    return gathered.select(F.col("conv").alias(conv), "n_unknown", whole.alias("formatted"), ends["spans"].alias("loss_spans"))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn to one row per conversation, as ``format_records`` gives it."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    record = F.to_variant_object(F.struct(plain(role).alias("role"), plain(text).alias("text")))
    return format_records(rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), record.alias("record")), "record", "conv", "turn").withColumnRenamed("conv", conv).drop("n_unknown")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text")
    )
    done = format_conversations(rows.unionByName(more))
    # the mask cut out of the formatted text, and the turns parsed from it
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(masked, "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL_OP10 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS e,
         replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), chr(10), '\n') AS er FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(er) + 1 + length(e) + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

QUERIES = {"op10_chat_formatting": op10_chat_formatting}
SQL = {"op10_chat_formatting": SQL_OP10}
