"""Chat formatting: typed content parts to text with ordered placeholders, attachments and expanded token counts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import fresh, on_worker
from loomtok.llm.token_count import CHUNK, OVERLAP, Counter, load_ranks

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


#: What an attachment is: its place in the conversation, from 0.
ATTACHMENT = "struct<place:bigint,kind:string,ref:string,tokens:bigint>"
#: A part counts for this many tokens at most, and a size for this much, so that no forged number overflows a sum.
MOST_TOKENS, MOST_SIZE = 10**12, 10**9
#: Where a mark ``<|...|>`` could begin in a text: a bar that follows ``<`` or stands first, where what comes before may end in ``<``.
MARK = "(^|<)\\|"


def harmless(text: Column) -> Column:
    """``text`` with a space within each ``<|``, and before a bar in front: no text makes a mark, alone or with its neighbours."""
    return F.regexp_replace(text, MARK, "$1 |")


def size(value: Column) -> Column:
    """A part's size as a double from 0 to ``MOST_SIZE``; null, negative and not-a-number are 0."""
    x = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.when(F.isnan(x) | (x < 0), F.lit(0.0)).otherwise(F.least(x, F.lit(float(MOST_SIZE))))


def visit(part: Column, patch: int, rate: int, per_page: int, text_tokens: Column | None = None) -> Column:
    """What one part gives: struct(piece, kind, ref, tokens); kind is null for what is no attachment.

    Text stands for itself, made :func:`harmless`, with ``text_tokens`` or else a token for each run of what isn't white
    space; an image takes one for each patch and two around; audio ``rate`` a second, a part counting whole; a document
    ``per_page`` a page. Sizes are bounded by :func:`size`, and a part's tokens by ``MOST_TOKENS``.
    """
    text = F.coalesce(part["text"], F.lit(""))
    patches = F.ceil(size(part["width"]) / patch).cast("double") * F.ceil(size(part["height"]) / patch) + 2
    kind = F.when(part["type"] == "text", F.lit(None)).otherwise(F.when(part["type"].isin("image", "audio", "document"), part["type"]).otherwise("unknown"))
    tokens = (
        F.when(part["type"] == "text", (F.regexp_count(text, F.lit("\\S+")) if text_tokens is None else text_tokens).cast("double"))
        .when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(size(part["seconds"]) * rate).cast("double"))
        .when(part["type"] == "document", size(part["pages"]) * per_page)
        .otherwise(0.0)
    )
    piece = F.when(part["type"] == "text", harmless(text)).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))
    return F.struct(piece.alias("piece"), kind.alias("kind"), part["ref"].alias("ref"), F.least(tokens, F.lit(float(MOST_TOKENS))).cast("bigint").alias("tokens"))


def with_counts(turns: DataFrame, ranks_path: str, name: str) -> DataFrame:
    """``turns`` with column ``name``: the number of ids of each part's text under a byte-level vocabulary, as the text stands in the result.

    The vocabulary is broadcast; a worker's batch of texts is counted at once.
    """
    ranks = turns.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    @F.arrow_udf("array<bigint>")
    def counted(texts: pa.Array) -> pa.Array:
        counter = on_worker(f"counter {ranks_path}", lambda: Counter(ranks.value, CHUNK, OVERLAP))
        return pa.array([[counter.count(t)[0] for t in row] for row in texts.to_pylist()], pa.list_(pa.int64()))

    texts = F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: F.when(p["type"] == "text", harmless(F.coalesce(p["text"], F.lit("")))))
    return turns.withColumn(name, counted(texts))


def chat_format(turns: DataFrame, patch: int = 14, rate: int = 25, per_page: int = 512, ranks_path: str | None = None) -> DataFrame:
    """(conv_id, text, attachments, n_tokens) of each conversation in ``turns`` (conv_id, turn, role, parts).

    ``parts`` is an array of ``PART``. A turn is ``<|role|>``, a new line, its parts in order, ``<|end|>`` and a new
    line. ``attachments`` is an array of ``ATTACHMENT``: what the placeholders stand for, in their order, the place
    counted over the conversation from 0. ``n_tokens`` adds up the tokens of all parts, see :func:`visit`; with
    ``ranks_path``, a file of a byte-level vocabulary, those of texts are numbers of ids.

    Texts and roles can't forge marks: :func:`harmless` breaks each ``<|`` in a text, so the n-th placeholder is the n-th
    attachment, and a role of other characters than ASCII letters, digits, ``_``, ``.`` and ``-`` is "unknown", as is
    a null one.

    Null and missing parts are left out; null ``parts`` are none. A part of another or no type is "unknown", with 0
    tokens; a null reference is empty. Sizes that are null, negative or not a number are 0, and larger ones than
    ``MOST_SIZE`` are that. Turns of the same number stand in order of role, then of their text; a null number comes
    first. A row without a conv_id is a conversation of its own. Repeated rows are repeated turns. A conversation is one
    row of the result, and so one task's. Other columns are left out. An empty table gives an empty table.
    """
    (counted,) = fresh(turns, "__chat_counts")
    given = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    if ranks_path is None:
        seen = F.transform(F.filter(given, lambda p: p.isNotNull()), lambda p: visit(p, patch, rate, per_page))
    else:
        turns = with_counts(turns, ranks_path, counted)
        both = F.filter(F.arrays_zip(given.alias("p"), F.col(counted).alias("n")), lambda x: x["p"].isNotNull())
        seen = F.transform(both, lambda x: visit(x["p"], patch, rate, per_page, x["n"]))
    role = F.when(F.rlike("role", F.lit("^[A-Za-z0-9_.-]+\\z")), F.col("role")).otherwise("unknown")
    rows = turns.select("conv_id", "turn", role.alias("role"), seen.alias("seen"))
    piece = F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.array_join(F.transform("seen", lambda s: s["piece"]), ""), F.lit("<|end|>\n"))
    files = F.transform(F.filter("seen", lambda s: s["kind"].isNotNull()), lambda s: F.struct(s["kind"].alias("kind"), F.coalesce(s["ref"], F.lit("")).alias("ref"), s["tokens"].alias("tokens")))
    tokens = F.aggregate("seen", F.lit(0).cast("bigint"), lambda a, s: a + s["tokens"])
    rows = rows.select("conv_id", F.struct("turn", "role", piece.alias("piece"), files.alias("files"), tokens.alias("tokens")).alias("t"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    done = rows.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    numbered = F.transform(F.flatten(F.transform("ts", lambda t: t["files"])), lambda f, i: F.struct(i.cast("bigint").alias("place"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))
    return done.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("text"),
        numbered.alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
    )


def typed(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts): the rows of conversations as typed parts, since the table has plain text only.

    A system turn brings a document, a user's an image before and an assistant's audio after its text, with sizes
    from the text's length.
    """
    n = F.char_length(F.coalesce("text", F.lit("")))

    def part(kind: str, ref: str | None = None, **sizes: Column) -> Column:
        name = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(f".{ref}")) if ref else F.lit(None)
        fields = {"type": F.lit(kind), "text": F.col("text") if kind == "text" else F.lit(None), "ref": name, "width": F.lit(None), "height": F.lit(None), "seconds": F.lit(None), "pages": F.lit(None)} | sizes
        return F.struct(*(c.alias(k) for k, c in fields.items())).cast(PART)

    text = part("text")
    parts = (
        F.when(F.col("role") == "system", F.array(text, part("document", "pdf", pages=1 + n % 7)))
        .when(F.col("role") == "user", F.array(part("image", "png", width=64 + n % 900, height=64 + n % 500), text))
        .when(F.col("role") == "assistant", F.array(text, part("audio", "wav", seconds=n / 16)))
        .otherwise(F.array(text))
    )
    return conversations.select("conv_id", "turn", "role", parts.alias("parts"))


def as_text(formatted: DataFrame) -> DataFrame:
    """Attachments as JSON, one string each, which engines compare alike."""
    return formatted.withColumn("attachments", F.transform("attachments", lambda a: F.to_json(a)))


ORACLE = r"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, role, regexp_replace(coalesce(text, ''), '(^|<)\|', '\1 |', 'g') AS text, coalesce(text, '') AS raw, length(coalesce(text, '')) AS n, conv_id || '/' || turn AS ref,
             CASE WHEN regexp_full_match(role, '[A-Za-z0-9_.-]+') THEN role ELSE 'unknown' END AS shown FROM conversations),
a AS (SELECT *, CASE role WHEN 'system' THEN text || '<|document|>' WHEN 'user' THEN '<|image|>' || text WHEN 'assistant' THEN text || '<|audio|>' ELSE text END AS body,
             CASE role WHEN 'system' THEN (1 + n % 7) * 512
                       WHEN 'user' THEN CAST(ceil((64 + n % 900) / 14.0) * ceil((64 + n % 500) / 14.0) + 2 AS BIGINT)
                       WHEN 'assistant' THEN CAST(ceil(n / 16.0 * 25) AS BIGINT) ELSE 0 END AS extra,
             len(regexp_extract_all(raw, '\S+')) AS words FROM c),
b AS (SELECT *, CASE role WHEN 'system' THEN 'document' WHEN 'user' THEN 'image' WHEN 'assistant' THEN 'audio' END AS kind,
             ref || CASE role WHEN 'system' THEN '.pdf' WHEN 'user' THEN '.png' ELSE '.wav' END AS file,
             '<|' || shown || '|>' || chr(10) || body || '<|end|>' || chr(10) AS piece FROM a),
k AS (SELECT *, count(kind) OVER (PARTITION BY conv_id, alone ORDER BY turn, shown, piece ROWS UNBOUNDED PRECEDING) - 1 AS place FROM b)
SELECT conv_id, string_agg(piece, '' ORDER BY turn, shown, piece) AS text,
       coalesce(list(CAST(to_json({'place': place, 'kind': kind, 'ref': file, 'tokens': extra}) AS VARCHAR) ORDER BY turn, shown, piece) FILTER (WHERE kind IS NOT NULL), []) AS attachments,
       CAST(sum(words + extra) AS BIGINT) AS n_tokens
FROM k GROUP BY conv_id, alone
"""
