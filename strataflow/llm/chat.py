"""Chat formatting with typed content parts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.sql import let, running

#: The template: OPEN role ": " content CLOSE for each turn, placeholders between PART and PART_END.
OPEN, MID, CLOSE, PART, PART_END = "### ", ": ", "</turn>\n", "<|", "|>"
#: Signs that every control string has, with the letter that stands for each behind a backslash: texts hold none of them as is, also
#: where the texts of neighbouring parts meet.
ESCAPES = [("<", "l"), ("#", "h")]

PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Token counts of placeholders: a patch of PATCH x PATCH pixels, a second of sound, a page.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 14, 25, 512


def escape(text: Column) -> Column:
    """``text`` without the signs of control strings, reversibly: a backslash is doubled, a sign becomes a backslash and a letter."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for plain, letter in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit("\\" + letter))
    return out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: doubled backslashes are set apart first, so that no other reading is left."""

    def piece(x: Column) -> Column:
        for plain, letter in ESCAPES:
            x = F.replace(x, F.lit("\\" + letter), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, r"\\\\"), lambda x: unescape(F.replace(x, F.lit("\\c"), F.lit(":")))), "\\")


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to; 0 for text and unknown kinds, at least 1 for an attachment."""
    patches = F.ceil(F.coalesce(part.width, F.lit(0)) / PATCH) * F.ceil(F.coalesce(part.height, F.lit(0)) / PATCH)
    return (
        F.when(part.kind == "image", F.greatest(F.lit(1), patches.cast("long")))
        .when(part.kind == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(part.seconds, F.lit(0.0)) * TOKENS_PER_SECOND).cast("long")))
        .when(part.kind == "document", F.greatest(F.lit(1), (F.coalesce(part.pages, F.lit(0)) * TOKENS_PER_PAGE).cast("long")))
        .otherwise(F.lit(0).cast("long"))
    )


def is_attachment(part: Column) -> Column:
    return F.coalesce(part.kind.isin("image", "audio", "document"), F.lit(False))


def flatten(parts: Column) -> Column:
    """The content string of typed parts in their order: escaped texts and numbered placeholders.

    An image, audio or document part becomes ``<|kind:n|>``, n counting the turn's attachments
    from 0; a part of another or no kind gives its text. Null parts are none.
    """
    some = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p: p.isNotNull())

    def visit(all_parts: Column) -> Column:
        numbers = running(F.transform(all_parts, lambda p: is_attachment(p).cast("int")), lambda a, b: a + b, F.lit(0))
        return let(numbers, lambda before: F.array_join(F.transform(all_parts, lambda p, i: one(p, F.get(before, i))), ""))

    def one(p: Column, number: Column) -> Column:
        return F.when(is_attachment(p), F.concat(F.lit(PART), p.kind, F.lit(":"), number.cast("string"), F.lit(PART_END))).otherwise(escape(p.text))

    return let(some, visit)


def attachments(parts: Column) -> Column:
    """(kind, ref, tokens) of the attachments, in the order of their placeholders."""
    some = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p: p.isNotNull() & is_attachment(p))
    return F.transform(some, lambda p: F.struct(p.kind.alias("kind"), p.ref.alias("ref"), part_tokens(p).alias("tokens")))


def text_part(text: Column) -> Column:
    """A row's text as its only part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def format_conversations(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """conv_id, formatted, attachments and n_expanded_tokens of each conversation.

    ``turns`` has conv_id, turn, role and either text or the column ``parts`` of typed parts
    (see ``PART_TYPE``). Rows are ordered by turn, then role and content; a null turn comes
    first, repeated rows are repeated, a null role or text is empty, rows of a null conv_id
    are one conversation. Each turn is formatted in its own row before rows meet; a
    conversation has to fit one row, as its formatted text is one value.
    """
    content = F.col(parts) if parts else text_part(F.col("text").cast("string"))
    line = F.concat(F.lit(OPEN), escape_role(F.col("role").cast("string")), F.lit(MID), flatten(content), F.lit(CLOSE))
    rows = turns.select(F.col("conv_id"), F.struct(F.col("turn"), line.alias("line"), attachments(content).alias("attached")).alias("row"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    files = F.flatten(F.transform("rows", lambda r: r.attached))
    return held.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r.line), "").alias("formatted"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda s, a: s + a.tokens).alias("n_expanded_tokens"),
    )


def parse(formatted: Column) -> Column:
    """(role, text) of each turn of a formatted conversation, unescaped; placeholders stay in the text."""
    lines = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def one(x: Column) -> Column:
        at = F.instr(x, MID)
        role = F.substring(x, len(OPEN) + 1, at - len(OPEN) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(x, at + len(MID), F.length(x))).alias("text"))

    return F.transform(lines, one)


def parse_parts(content: Column) -> Column:
    """(text, kind, number) of a formatted turn's pieces: each placeholder with the unescaped text before it, then the text behind the last.

    Number counts the turn's attachments from 0, in the order of the column ``attachments``.
    """
    pattern = r"<\|(image|audio|document):([0-9]+)\|>"

    def of(texts: Column) -> Column:
        kinds, numbers = (F.regexp_extract_all(content, F.lit(pattern), F.lit(k)) for k in (1, 2))
        return let(F.struct(kinds.alias("k"), numbers.alias("n")), lambda z: F.transform(texts, lambda x, i: F.struct(unescape(x).alias("text"), F.get(z.k, i).alias("kind"), F.get(z.n, i).cast("int").alias("number"))))

    return let(F.split(content, pattern, -1), of)


def contents(formatted: Column) -> Column:
    """The formatted content of each turn, as it is between the template's marks."""
    lines = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    return F.transform(lines, lambda x: F.substring(x, F.instr(x, MID) + len(MID), F.length(x)))


def digests(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Counts and digests of conversations, all read back from the column ``formatted``.

    turns_sha256 is over role, newline, text, newline of each turn; loss_sha256 over the
    texts under the loss mask, which are those of ``loss_role``.
    """
    turns = formatted.select("*", parse(F.col("formatted")).alias("__turns"))
    loss = F.array_join(F.transform(F.filter("__turns", lambda t: t.role == loss_role), lambda t: t.text), "")
    both = turns.withColumn("__loss", loss)
    all_turns = F.array_join(F.transform("__turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return both.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
