"""Streamed responses put together again from recorded chunks.

A chunk is a piece of a server-sent event stream, cut anywhere, even inside a character. A response may have any number
of chunks, so no step holds all rows of one: bytes are joined per slice of chunks, lines that cross a slice border per
line, and texts in pieces of consecutive events before the pieces are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions import derive
from gatelens.functions import usage as U
from gatelens.functions.usage import has_key
from gatelens.operators.cooldown import as_us
from gatelens.operators.running import int_div, running

CHUNKS_PER_SLICE = 1024
SLICES_PER_RUN = 4096
EVENTS_PER_PIECE = 4096

# Line prefix and end marker of the stream format.
DATA_PREFIX = "data:"
DONE = "[DONE]"


def _whole_json(text: Column) -> Column:
    """An array with the text as VARIANT if all of it is one JSON value, else an empty one; the text is parsed once.

    The parser stops after the first value. So the text is parsed as the first of two entries of an array, the second
    being its own hash: what follows the value is a mistake then, and no text can bring the closing part itself. The
    result of the parse is an array's entry, because the optimizer would write it out again wherever a column is used.
    """
    mark = F.xxhash64(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    whole = F.filter(F.array(pair), lambda p: F.try_variant_get(p, "$[1]", "bigint") == mark)
    return F.transform(whole, lambda p: F.try_variant_get(p, "$[0]", "variant"))


def whole_json(text: str | Column) -> Column:
    """A text as VARIANT if all of it is one JSON value, else NULL."""
    return F.get(_whole_json(F.col(text) if isinstance(text, str) else text), F.lit(0))


def _byte_lines(chunks: DataFrame, chunks_per_slice: int) -> DataFrame:
    """``request_id, provider_type, pos, part``: lines as single-byte text, which ``_decoded`` makes characters of.

    ``chunks`` has one provider type per request. A line break byte never occurs inside a UTF-8 character, so lines are
    cut from bytes (as single-byte text, which keeps every byte) and decoded whole; bytes that are no UTF-8 become
    replacement characters. A carriage return ends a line too, so that both together leave an empty line between, which
    means nothing in a stream. Copies of a chunk (same ``seq``) count once. Only the first and last part of each slice are looked at a second time.
    """
    key = ["request_id", "provider_type"]
    text = """translate(array_join(transform(filter(found, (c, i) -> i = 0 or c.seq <> found[i - 1].seq),
        c -> decode(c.data, 'ISO-8859-1')), ''), '\\r', '\\n')"""
    slices = (
        chunks.select(*key, "seq", "data", int_div(F.col("seq"), chunks_per_slice).alias("slice"))
        .groupBy(*key, "slice")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("found"))
        .select(*key, "slice", F.expr(text).alias("text"))
    )
    base = F.shiftleft(F.col("slice"), 32)
    # the lines between a slice's first and last break, as one expression: of a column the optimizer would test the size
    between = "if(size(p) > 2, slice(p, 2, size(p) - 2), cast(array() as array<string>))"
    inner = slices.select(
        *key, "slice", F.posexplode(F.expr(f"transform(array(split(text, '\\n')), p -> {between})[0]")).alias("i", "part")
    ).select(*key, (base + F.col("i") + 1).alias("pos"), "part")

    # every slice's last part begins a line, unless the slice has no line break at all
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    first = F.struct(base.alias("pos"), F.substring_index("text", "\n", 1).alias("part"), F.lit(False).alias("begins"))
    last = F.struct(
        (base + breaks).alias("pos"), F.substring_index("text", "\n", -1).alias("part"), F.lit(True).alias("begins")
    )
    ends = slices.select(*key, "slice", F.inline(F.when(breaks > 0, F.array(first, last)).otherwise(F.array(first))))
    lines_of_ends = running(
        ends,
        key,
        ["pos"],
        int_div(F.col("slice"), SLICES_PER_RUN),
        {"begun": ("max", F.when(F.col("begins"), F.col("pos")))},
    )
    outer = (
        lines_of_ends.groupBy(*key, "begun")
        .agg(
            F.min("pos").alias("pos"),
            F.expr("listagg(part, '') within group (order by pos)").alias("part"),
        )
        .drop("begun")
    )
    return inner.unionByName(outer.select(*key, "pos", "part"))


def _decoded(text: str | Column) -> Column:
    return F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))


def sse_lines(chunks: DataFrame, *, chunks_per_slice: int = CHUNKS_PER_SLICE) -> DataFrame:
    """Lines of every response: ``request_id, provider_type, pos, line``; ``pos`` gives their order."""
    lines = _byte_lines(chunks, chunks_per_slice)
    return lines.select("request_id", "provider_type", "pos", _decoded("part").alias("line"))


def sse_events(chunks: DataFrame, *, chunks_per_slice: int = CHUNKS_PER_SLICE, key: str | None = None) -> DataFrame:
    """JSON events of every response: ``request_id, provider_type, pos, v``.

    Other lines, empty payloads, the end marker and text that is no JSON are left out. With ``key``, so are events in
    which no object has that key, as far as the text tells without being parsed: it has neither the key nor an escape
    that could spell it.
    """
    # prefix, key and end marker are plain ASCII and are looked for in the bytes, so that only payloads are decoded
    lines = _byte_lines(chunks, chunks_per_slice).filter(F.col("part").startswith(DATA_PREFIX))
    if key is not None:
        lines = lines.filter(F.col("part").contains(key) | F.col("part").contains("\\u"))
    payload = F.trim(F.substring("part", len(DATA_PREFIX) + 1, 2**31 - 1), F.lit(" \t\r"))
    return (
        lines.filter(~payload.isin("", DONE))
        .select("request_id", "provider_type", "pos", _decoded(payload).alias("payload"))
        .select("request_id", "provider_type", "pos", F.explode(_whole_json(F.col("payload"))).alias("v"))
    )


def _text(path: str, doc: str | Column = "v") -> Column:
    return F.try_variant_get(doc, path, "string")


def _index(doc: str | Column) -> Column:
    return F.coalesce(F.try_variant_get(doc, "$.index", "bigint"), F.lit(0).cast("bigint"))


NOBODY = -1  # index of rows that belong to no choice, block or tool call


def _piece() -> Column:
    """Consecutive events that are joined together first, so that no task holds all events of a response."""
    return int_div(F.col("pos"), EVENTS_PER_PIECE).alias("piece")


def _last(value: Column, present: Column, order: Column) -> Column:
    """(order, value) of the last row where the value is present, as a plain max; a present NULL is a value."""
    return F.max(F.when(present, F.struct(order.alias("order"), value.alias("value"))))


def _first(value: Column, present: Column, order: Column) -> Column:
    return F.min(F.when(present, F.struct(order.alias("order"), value.alias("value"))))


def _listagg(text: str, order: str) -> Column:
    return F.expr(f"listagg({text}, '') within group (order by {order})").alias(text)


def _padded(array: str, empty: str) -> Column:
    """Entries by index from 0 on of an array of structs (idx, x), gaps filled; ``empty`` may use the index ``i``.

    One pass over the entries: each brings the empty ones between its predecessor and itself.
    """
    before = "if(k = 0, -1L, e_[k - 1].idx)"
    gap = f"if(e.idx > {before} + 1, transform(sequence({before} + 1, e.idx - 1), i -> {empty}), array())"
    one = f"transform(array(array_sort({array})), e_ -> flatten(transform(e_, (e, k) -> concat({gap}, array(e.x)))))"
    return F.expr(f"{one}[0]")


_CALL = "struct<id: string, type: string, function: struct<name: string, arguments: string>>"
_MESSAGE = f"struct<role: string, content: string, reasoning_content: string, tool_calls: array<{_CALL}>>"
_CHOICE = f"struct<index: bigint, message: {_MESSAGE}, finish_reason: string>"
_TEXTS_OPENAI = ["content", "reasoning_content", "arguments"]
_LAST_OPENAI = ["role", "finish_reason", "call_id", "type", "name", "usage"]
_FIRST_OPENAI = ["id", "created", "model"]


def _openai_rows(events: DataFrame) -> DataFrame:
    """One row per event and choice, and one per tool call in it; the event is read once for all fields."""
    per_choice = events.select(
        "request_id", "pos", "v", F.posexplode_outer(F.try_variant_get("v", "$.choices", "array<variant>")).alias("at", "c")
    )
    calls = F.coalesce(F.try_variant_get("c", "$.delta.tool_calls", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    nothing = F.expr("array(cast(null as variant))")  # stands for the choice itself
    rows = per_choice.select(
        "request_id",
        "pos",
        F.coalesce("at", F.lit(0)).alias("at"),
        "v",
        "c",
        F.posexplode(F.concat(nothing, calls)).alias("call_at", "t"),
    )
    own = F.col("call_at") == 0
    is_head = own & (F.col("at") == 0)
    usage = F.try_variant_get("v", "$.usage", "variant")
    c, t = F.col("c"), F.col("t")
    none = F.lit(NOBODY).cast("bigint")
    return rows.select(
        "request_id",
        _piece(),
        F.struct("pos", "at", "call_at").alias("order"),
        F.when(c.isNull(), none).otherwise(_index(c)).alias("idx"),
        F.when(own, none).otherwise(_index(t)).alias("tool"),
        is_head.alias("is_head"),
        F.when(is_head, F.coalesce(_text("$.id"), F.lit(""))).alias("id"),
        F.when(is_head, _text("$.created")).alias("created"),
        F.when(is_head, F.coalesce(_text("$.model"), F.lit(""))).alias("model"),
        F.when(is_head, F.to_json(usage)).alias("usage"),
        (is_head & usage.isNotNull() & ~F.is_variant_null(usage)).alias("has_usage"),
        F.when(own, _text("$.delta.content", c)).alias("content"),
        F.when(own, _text("$.delta.reasoning_content", c)).alias("reasoning_content"),
        F.when(own, _text("$.delta.role", c)).alias("role"),
        (own & has_key(c, "$.delta.role")).alias("has_role"),
        F.when(own, _text("$.finish_reason", c)).alias("finish_reason"),
        (own & has_key(c, "$.finish_reason")).alias("has_finish_reason"),
        _text("$.function.arguments", t).alias("arguments"),
        _text("$.id", t).alias("call_id"),
        has_key(t, "$.id").alias("has_call_id"),
        _text("$.type", t).alias("type"),
        has_key(t, "$.type").alias("has_type"),
        _text("$.function.name", t).alias("name"),
        has_key(t, "$.function.name").alias("has_name"),
        has_key(t, "$.function").alias("has_function"),
    )


def response_parts(events: DataFrame) -> DataFrame:
    """Texts of choices and tool calls in ordered parts: ``request_id, idx, tool, piece`` and the texts of the piece.

    This is the merge without its last step. A merged document is one row and can be no larger than one; the parts of
    a response have no such limit.
    """
    order = F.col("order")
    return _openai_rows(events).groupBy("request_id", "idx", "tool", "piece").agg(
        *[_listagg(text, "order") for text in _TEXTS_OPENAI],
        *[_last(F.col(n), F.col(f"has_{n}"), order).alias(n) for n in _LAST_OPENAI],
        *[_first(F.col(n), F.col("is_head"), order).alias(n) for n in _FIRST_OPENAI],
        F.max("has_function").alias("has_function"),
    )


def merge_openai(events: DataFrame) -> DataFrame:
    """Full response per request from choice deltas.

    Result: ``request_id, id, object, created, model, choices, usage``. Choices and tool calls stand at their index,
    gaps are empty. Usage is the last one that is not null; missing texts are empty.
    """
    # from here on everything is partitioned by request, and the groupings need no further shuffle
    pieces = response_parts(events).repartition("request_id")
    slots = pieces.groupBy("request_id", "idx", "tool").agg(
        *[_listagg(text, "piece") for text in _TEXTS_OPENAI],
        *[F.max(n).alias(n) for n in _LAST_OPENAI],
        *[F.min(n).alias(n) for n in _FIRST_OPENAI],
        F.max("has_function").alias("has_function"),
    )
    is_call = F.col("tool") > NOBODY
    function = F.when(
        F.col("has_function"),
        F.struct(
            F.coalesce("name.value", F.lit("")).alias("name"), F.coalesce("arguments", F.lit("")).alias("arguments")
        ),
    )
    call = F.struct(F.col("call_id.value").alias("id"), F.col("type.value").alias("type"), function.alias("function"))
    choices = slots.groupBy("request_id", "idx").agg(
        *[F.min(n).alias(n) for n in _FIRST_OPENAI],
        *[F.max(n).alias(n) for n in ("usage", "role", "finish_reason", "content", "reasoning_content")],
        F.collect_list(F.when(is_call, F.struct(F.col("tool").alias("idx"), call.alias("x")))).alias("calls"),
    )
    empty_call = f"cast(named_struct('id', null, 'type', null, 'function', null) as {_CALL})"
    message = F.struct(
        F.col("role.value").alias("role"),
        F.coalesce("content", F.lit("")).alias("content"),
        "reasoning_content",
        _padded("calls", empty_call).cast(f"array<{_CALL}>").alias("tool_calls"),
    )
    is_choice = F.col("idx") > NOBODY
    choice = F.struct(
        F.col("idx").alias("index"), message.alias("message"), F.col("finish_reason.value").alias("finish_reason")
    )
    whole = choices.groupBy("request_id").agg(
        *[F.min(n).alias(n) for n in _FIRST_OPENAI],
        F.max("usage").alias("usage"),
        F.collect_list(F.when(is_choice, F.struct("idx", choice.cast(_CHOICE).alias("x")))).alias("found"),
    )
    empty_choice = (
        "named_struct('index', i, 'message', named_struct('role', string(null), 'content', '', 'reasoning_content', "
        f"string(null), 'tool_calls', cast(array() as array<{_CALL}>)), 'finish_reason', string(null))"
    )
    return whole.select(
        "request_id",
        F.col("id.value").alias("id"),
        F.lit("chat.completion").alias("object"),
        F.col("created.value").try_cast("bigint").alias("created"),
        F.col("model.value").alias("model"),
        _padded("found", empty_choice).cast(f"array<{_CHOICE}>").alias("choices"),
        F.parse_json("usage.value").alias("usage"),
    )


# Usage counts that streams of this format report; each is taken from its last event.
ANTHROPIC_USAGE = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]


_TEXTS = ["text", "thinking", "signature", "partial_json"]
_START_FIELDS = {"block_type": "type", "block_id": "id", "name": "name"}
_BLOCK = (
    "struct<type: string, id: string, name: string, text: string, thinking: string, signature: string, input: string>"
)


def _last_by_key(entries: str) -> str:
    """Key-wise last values, as entries, of a sorted array of structs with ``open``, an array of (key, json)."""
    return f"""map_entries(aggregate({entries}, cast(map() as map<string, string>), (found, e) -> map_concat(
        map_filter(found, (k, j) -> not exists(e.open, o -> o.key = k)), map_from_entries(e.open))))"""


def _object(entries: str) -> str:
    """JSON text of an object from entries (key, json)."""
    key = "substring(to_json(named_struct('k', o.key)), 6, length(to_json(named_struct('k', o.key))) - 6)"
    return f"concat('{{', array_join(transform({entries}, o -> concat({key}, ':', o.value)), ','), '}}')"


def _anthropic_rows(events: DataFrame) -> DataFrame:
    """One row per event with all fields that matter."""
    typed = events.withColumn("kind", _text("$.type")).filter("kind is not null")
    kind = F.col("kind")
    starting, adding = kind == "content_block_start", kind == "content_block_delta"
    usage = F.when(kind == "message_start", F.try_variant_get("v", "$.message.usage", "variant")).when(
        kind == "message_delta", F.try_variant_get("v", "$.usage", "variant")
    )
    whole = F.when(starting, F.try_variant_get("v", "$.content_block", "variant")).otherwise(usage)
    return typed.select(
        "request_id",
        "pos",
        _piece(),
        F.transform(
            F.map_entries(F.try_variant_get(whole, "$", "map<string, variant>")),
            lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json")),
        ).alias("open"),
        F.when(starting | adding, _index("v")).otherwise(F.lit(NOBODY).cast("bigint")).alias("idx"),
        starting.alias("starting"),
        F.coalesce(_text("$.message.id"), F.lit("")).alias("id"),
        F.coalesce(_text("$.message.model"), F.lit("")).alias("model"),
        _text("$.delta.stop_reason").alias("stop_reason"),
        ((kind == "message_delta") & has_key(F.col("v"), "$.delta.stop_reason")).alias("has_stop_reason"),
        *[F.try_variant_get(usage, f"$.{name}", "bigint").alias(name) for name in ANTHROPIC_USAGE],
        *[F.when(starting, _text(f"$.content_block.{path}")).alias(name) for name, path in _START_FIELDS.items()],
        F.when(starting, F.to_json(F.try_variant_get("v", "$.content_block.input", "variant"))).alias("input"),
        *[
            F.when(starting, _text(f"$.content_block.{name}")).when(adding, _text(f"$.delta.{name}")).alias(name)
            for name in _TEXTS
        ],
    )


def merge_anthropic(events: DataFrame) -> DataFrame:
    """Full response per request from content-block events.

    Result: ``request_id, id, type, role, model, content, stop_reason, usage, start_blocks, whole_usage``. The last two
    are VARIANT and keep every key, the last value of each, a null included: ``start_blocks`` the blocks as their starts
    bring them, in the places of ``content``, ``whole_usage`` the usage. A block exists from its start event on;
    deltas of blocks that have not started are dropped. Gaps before a started block are empty. A block may start again:
    each text then begins anew with the last start that brings this text, other fields keep their last value.
    """
    rows = _anthropic_rows(events)
    pos, always = F.col("pos"), F.lit(True)
    kept = [*_START_FIELDS, "input", *ANTHROPIC_USAGE]  # of these the last value that is not null
    # A text begins with the last start that brings it, or with the first start. That may lie in another piece than its
    # deltas. So a piece hands on the text from its own beginning and what precedes its first start, and the pieces are
    # joined from the one that has the beginning.
    pieces = (
        rows.groupBy("request_id", "idx", "piece")
        .agg(
            *[_first(F.col(n), always, pos).alias(n) for n in ("id", "model")],
            _last(F.col("stop_reason"), F.col("has_stop_reason"), pos).alias("stop_reason"),
            *[_last(F.col(n), F.col(n).isNotNull(), pos).alias(n) for n in kept],
            F.min(F.when(F.col("starting"), pos)).alias("start"),
            *[F.max(F.when(F.col("starting") & F.col(n).isNotNull(), pos)).alias(f"begin_{n}") for n in _TEXTS],
            F.array_sort(
                F.collect_list(F.when(F.col("idx") > NOBODY, F.struct("pos", *_TEXTS)))
            ).alias("parts"),
            F.array_sort(F.collect_list(F.when(F.col("open").isNotNull(), F.struct("pos", "open")))).alias("opened"),
        )
        .select(
            "request_id",
            "idx",
            "piece",
            "id",
            "model",
            "stop_reason",
            *kept,
            F.col("start").isNotNull().alias("has_start"),
            *[F.col(f"begin_{n}").isNotNull().alias(f"begins_{n}") for n in _TEXTS],
            F.struct(
                *[_text_of(f"filter(parts, p -> begin_{n} is null and p.pos < start)", n) for n in _TEXTS]
            ).alias("before"),
            F.struct(
                *[_text_of(f"filter(parts, p -> p.pos >= coalesce(begin_{n}, start, p.pos))", n) for n in _TEXTS]
            ).alias("after"),
            F.expr(_last_by_key("opened")).alias("open"),
        )
        .repartition("request_id")
    )
    blocks = pieces.groupBy("request_id", "idx").agg(
        *[F.min(n).alias(n) for n in ("id", "model")],
        *[F.max(n).alias(n) for n in ("stop_reason", *kept)],
        F.min(F.when(F.col("has_start"), F.col("piece"))).alias("first"),
        *[F.max(F.when(F.col(f"begins_{n}"), F.col("piece"))).alias(f"from_{n}") for n in _TEXTS],
        F.array_sort(
            F.collect_list(F.when(F.col("idx") > NOBODY, F.struct("piece", "before", "after")))
        ).alias("pieces"),
        F.array_sort(F.collect_list(F.struct("piece", F.expr("transform(open, o -> struct(o.key as key, o.value as json))").alias("open")))).alias("opened"),
    )
    blocks = blocks.withColumn("open", F.expr(_object(_last_by_key("opened"))))

    def from_start(name: str) -> str:
        return f"""flatten(transform(filter(pieces, p -> p.piece >= coalesce(from_{name}, first)),
            p -> if(p.piece = coalesce(from_{name}, first), array(p.after), array(p.before, p.after))))"""

    texts = blocks.withColumns({n: _text_of(from_start(n), n) for n in _TEXTS})
    parsed = F.coalesce(whole_json("partial_json"), F.parse_json(F.lit("{}")))
    block = F.struct(
        F.col("block_type.value").alias("type"),
        F.col("block_id.value").alias("id"),
        F.col("name.value").alias("name"),
        "text",
        "thinking",
        "signature",
        F.when(F.col("partial_json").isNotNull(), F.to_json(parsed)).otherwise(F.col("input.value")).alias("input"),
    )
    is_block = F.col("first").isNotNull()
    whole = texts.groupBy("request_id").agg(
        *[F.min(n).alias(n) for n in ("id", "model")],
        *[F.max(n).alias(n) for n in ("stop_reason", *ANTHROPIC_USAGE)],
        F.collect_list(F.when(is_block, F.struct("idx", block.cast(_BLOCK).alias("x")))).alias("found"),
        F.collect_list(F.when(is_block, F.struct("idx", F.col("open").alias("x")))).alias("started"),
        F.max(F.when(F.col("idx") == NOBODY, F.col("open"))).alias("whole_usage"),
    )
    return whole.select(
        "request_id",
        F.col("id.value").alias("id"),
        F.lit("message").alias("type"),
        F.lit("assistant").alias("role"),
        F.col("model.value").alias("model"),
        _padded("found", f"cast(null as {_BLOCK})").cast(f"array<{_BLOCK}>").alias("content"),
        F.col("stop_reason.value").alias("stop_reason"),
        F.struct(*[F.col(f"{n}.value").alias(n) for n in ANTHROPIC_USAGE]).alias("usage"),
        F.transform(_padded("started", "cast(null as string)"), F.parse_json).alias("start_blocks"),
        F.parse_json(F.coalesce("whole_usage", F.lit("{}"))).alias("whole_usage"),
    )


def _text_of(parts: str, field: str) -> Column:
    """One field of an array of structs in one text; NULL if no part has it."""
    values = f"filter(transform({parts}, p -> p.{field}), x -> x is not null)"
    return F.expr(f"if(size({values}) > 0, array_join({values}, ''), null)").alias(field)


def tool_inputs(merged: DataFrame) -> DataFrame:
    """Tool calls of merged responses of either format: request, position, id, name and the input as VARIANT.

    Input that is no JSON becomes an empty object.
    """
    nothing = F.parse_json(F.lit("{}"))
    if "content" in merged.columns:
        blocks = merged.select("request_id", F.posexplode("content").alias("position", "b")).filter("b.type = 'tool_use'")
        return blocks.select(
            "request_id",
            "position",
            F.col("b.id").alias("id"),
            F.col("b.name").alias("name"),
            F.coalesce(whole_json("b.input"), nothing).alias("input"),
        )
    calls = merged.select("request_id", F.explode("choices").alias("c")).select(
        "request_id", F.posexplode("c.message.tool_calls").alias("position", "t")
    )
    return calls.select(
        "request_id",
        "position",
        F.col("t.id").alias("id"),
        F.col("t.function.name").alias("name"),
        F.coalesce(whole_json("t.function.arguments"), nothing).alias("input"),
    )


def chunk_timing(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Total duration and time to the first chunk of each streamed response, from the start of its request.

    ``requests``: request_id, start_ts, and any further columns to keep; one row per request.
    """
    spans = chunks.groupBy("request_id", "provider_type").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return _timed(spans, requests)


def _timed(spans: DataFrame, requests: DataFrame) -> DataFrame:
    start = as_us(F.col("start_ts"))
    return spans.join(requests, "request_id").withColumns(
        {
            "duration_ms": (as_us(F.col("last_ts")) - start) / 1000,
            "time_to_first_token_ms": (as_us(F.col("first_ts")) - start) / 1000,
        }
    )


def stream_usage(events: DataFrame) -> DataFrame:
    """Token usage of streamed responses straight from their events, without merging texts: request_id, provider_type
    and usage.

    One hash aggregation over fixed-width values for both formats.
    """
    kind, v = _text("$.type"), F.col("v")
    whole = U.usage_openai(v)  # reported as a whole: the last one that is not null
    given = has_key(v, "$.usage") & ~F.is_variant_null(F.try_variant_get("v", "$.usage", "variant"))
    part = F.when(kind == "message_start", F.try_variant_get("v", "$.message.usage", "variant")).when(
        kind == "message_delta", F.try_variant_get("v", "$.usage", "variant")
    )
    openai = F.col("provider_type") == "openai"
    anthropic = F.col("provider_type") == "anthropic"
    whole_names = ["prompt_tokens", "completion_tokens", "cached_tokens"]
    rows = events.select(
        "request_id",
        "provider_type",
        "pos",
        F.when(openai & given, F.col("pos")).alias("given_at"),
        F.when(openai & given, whole).alias("whole"),
        F.when(anthropic, part).alias("part"),
    ).select(
        "request_id",
        "provider_type",
        "pos",
        "given_at",
        *[F.col(f"whole.{name}").alias(name) for name in whole_names],
        # reported in parts: each count from the last event that has it
        *[F.try_variant_get("part", f"$.{name}", "bigint").alias(name) for name in ANTHROPIC_USAGE],
    )
    last = rows.groupBy("request_id", "provider_type").agg(
        *[F.max_by(name, "given_at").alias(name) for name in whole_names],
        *[
            F.max_by(name, F.when(F.col(name).isNotNull(), F.col("pos"))).alias(f"part_{name}")
            for name in ANTHROPIC_USAGE
        ],
    )

    parts = [F.col(f"part_{name}") for name in ANTHROPIC_USAGE]
    return last.select("request_id", "provider_type", _usage_of(*map(F.col, whole_names), *parts).alias("usage"))


def _usage_of(*counts: Column) -> Column:
    """Usage from the counts of both formats, of which a response has one; missing ones are 0."""
    prompt, completion, cached, given, output, created, read = (F.coalesce(c, F.lit(0).cast("bigint")) for c in counts)
    prompt, completion = prompt + given + created + read, completion + output
    return F.struct(
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
        (cached + read).alias("cached_tokens"),
    )


def stats_from_chunks(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Request stats of streamed responses from their chunks: timing and usage of each.

    ``requests``: request_id, provider_name, start_ts, one row per request. A response whose stream broke off is
    counted like any other.
    """
    usage = stream_usage(sse_events(chunks, key="usage"))
    timed = chunk_timing(chunks, requests.select("request_id", "provider_name", "start_ts"))
    return _stats(timed.join(usage, ["request_id", "provider_type"], "left"))


def stats_of_closed(closed: DataFrame, requests: DataFrame) -> DataFrame:
    """The same from the rows of ``streaming.stats.closed_responses``, stored or still a stream; late rows are left out."""
    counts = ["prompt_tokens", "completion_tokens", "cached_tokens", *ANTHROPIC_USAGE]
    spans = closed.filter(~F.col("late")).select(
        "request_id", "provider_type", "first_ts", "last_ts", _usage_of(*map(F.col, counts)).alias("usage")
    )
    return _stats(_timed(spans, requests.select("request_id", "provider_name", "start_ts")))


def _stats(timed: DataFrame) -> DataFrame:
    return timed.select(
        "request_id",
        F.col("last_ts").alias("timestamp"),
        "provider_type",
        "provider_name",
        derive.round_ms(F.col("duration_ms")).alias("latency_ms"),
        F.lit(True).alias("is_streaming"),
        derive.round_ms(F.col("time_to_first_token_ms")).alias("time_to_first_token_ms"),
        F.coalesce("usage.prompt_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("usage.completion_tokens", F.lit(0)).alias("output_tokens"),
        F.coalesce("usage.cached_tokens", F.lit(0)).alias("cached_tokens"),
    )
