"""The registered queries of the numbered operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import chat, decontam, grammar, langid, mixing, packing, quality, rules, secrets, simhash, toxicity, trie, whitening
from strataflow.session import table


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, its share and the language mixture of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


#: Checks the escapes: its texts hold a backslash and both of the template's markers.
PROBE = "\\### Assistant: </turn> ok"


def op3_typed_content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.union(probe)))


ORACLE_3 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), own as (
  select *, replace(replace(replace(text, '\', '\\'), '<', '\l'), '#', '\h') as safe,
    replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '#', '\h'), ':', '\c') as safe_role
  from turns
), grouped as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, safe_role || ': ' || safe) as all_turns,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, safe_role || ': ' || safe), '') as loss,
    sum(length('### ' || safe_role || ': ' || safe || '</turn>' || chr(10))) as formatted_chars
  from own group by conv_id
)
select conv_id, n_turns, sha256(all_turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars
from grouped
"""


def chat_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with typed parts: each turn's text in two halves around an image, a sound of the turn's length and a document.

    Sizes follow from the text, so that placeholders, references and expanded token counts of
    every turn are checked.
    """
    turns = table(spark, sf_dir, "conversations")
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    ref = lambda kind: F.concat(F.lit(kind + "-"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    fields = {"kind": "string", "text": "string", "ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = lambda **k: F.struct(*[k.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()])
    parts = F.array(
        part(kind=F.lit("text"), text=F.substring(text, F.lit(1), half)),
        part(kind=F.lit("image"), ref=ref("i"), width=F.length(text), height=F.lit(28)),
        part(kind=F.lit("text"), text=F.substring(text, half + 1, F.length(text))),
        part(kind=F.lit("audio"), ref=ref("a"), seconds=F.length(text) / 16),
        part(kind=F.lit("document"), ref=ref("d"), pages=F.floor(F.length(text) / 1000)),
    )
    out = chat.format_conversations(turns.select("conv_id", "turn", "role", parts.alias("parts")), "parts")
    return out.select("conv_id", F.sha2("formatted", 256).alias("formatted_sha256"), F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a.kind, a.ref, a.tokens.cast("string"))), ",").alias("attached"), "n_expanded_tokens")


ORACLE_ATTACHMENTS = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, length(coalesce(text, '')) as n from conversations
), own as (
  select *, replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '#', '\h'), ':', '\c') as safe_role,
    replace(replace(replace(substr(text, 1, n // 2), '\', '\\'), '<', '\l'), '#', '\h') as a, replace(replace(replace(substr(text, n // 2 + 1), '\', '\\'), '<', '\l'), '#', '\h') as b,
    '-' || coalesce(cast(conv_id as varchar), '') || '-' || coalesce(cast(turn as varchar), '') as ref,
    greatest(1, cast(ceil(n / 14.0) as bigint) * 2) as i, greatest(1, cast(ceil(n / 16.0 * 25) as bigint)) as s, greatest(1, n // 1000 * 512) as d
  from turns
), lines as (
  select *, '### ' || safe_role || ': ' || a || '<|image:0|>' || b || '<|audio:1|><|document:2|></turn>' || chr(10) as line,
    'image:i' || ref || ':' || i || ',audio:a' || ref || ':' || s || ',document:d' || ref || ':' || d as files from own
)
select conv_id, sha256(string_agg(line, '' order by turn nulls first, line)) as formatted_sha256, string_agg(files, ',' order by turn nulls first, line) as attached,
  cast(sum(i + s + d) as bigint) as n_expanded_tokens
from lines group by conv_id
"""


def op4_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other numbers, names or units."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_cascade_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the cascade's verdict on every document."""
    return rules.quality_rules(table(spark, sf_dir, "documents"))


ORACLE_5 = r"""
with own as (
  select doc_id, coalesce(text, '') as text from documents
), split as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    length(regexp_replace(text, '[^\p{L}]+', '', 'g')) as letters,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as uppers
  from own
), grams as (
  select *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as g from split
), places as (
  select doc_id, rowid_, unnest(g) as gram, unnest(range(1, len(g) + 1)) as i
  from (select *, row_number() over () as rowid_ from grams)
), twice as (
  select rowid_, i from (select *, count(*) over (partition by rowid_, gram) as n from places) where n > 1
), covered as (
  select rowid_, count(distinct p) as n from (select rowid_, unnest([i, i + 1, i + 2]) as p from twice) group by rowid_
), counted as (
  select g.doc_id, g.text, len(w) as n_words, length(regexp_replace(g.text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(g.text) - length(regexp_replace(g.text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
    letters, uppers, length(g.text) - length(replace(g.text, '!', '')) as bangs, len(string_split(g.text, chr(10))) as n_lines
  from (select *, row_number() over () as rowid_ from grams) g left join covered c on c.rowid_ = g.rowid_
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words
    or n_symbols * 10 > n_words or word_chars > 12 * n_words or n_dup_lines * 2 > n_lines
    or uppers * 2 > letters or letters * 2 < word_chars or bangs * 2 > n_words) as kept
from counted
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in packed sequences of 4096 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by way of a ledger that a first pass begins and a second one adds the newer rules to."""
    return secrets.secrets(secrets.ledger_findings(table(spark, sf_dir, "documents")))


def _spans_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  select doc_id, {order} as ord, '{kind}' as kind, unnest(pos) as pos, unnest(len) as len from (
    select doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i:
        case when length(g[i]) >= {least} then list_sum(list_transform(range(1, i + 1), lambda j: length(gaps[j])))
          + coalesce(list_sum(list_transform(range(1, i), lambda j: length(m[j]))), 0) end), lambda x: x is not null) as pos,
      list_filter(list_transform(range(1, len(m) + 1), lambda i: case when length(g[i]) >= {least} then length(m[i]) end), lambda x: x is not null) as len
    from (select doc_id, regexp_split_to_array(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}', 0) as m,
        regexp_extract_all(text, '{pattern}', {group}) as g from own where regexp_matches(text, '{pattern}')))"""


ORACLE_7 = (
    "with own as (select doc_id, coalesce(text, '') as text from documents), spans as ("
    + " union all ".join(_spans_sql(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(secrets.RULES))
    + """
), joined as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    coalesce(string_agg(kind || ':' || cast(pos as bigint) || ':' || cast(pos + len as bigint), ',' order by pos, ord) filter (ord < 3), '') as base,
    string_agg(kind || ':' || cast(pos as bigint) || ':' || cast(pos + len as bigint), ',' order by pos, ord) as spans
  from spans group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from own d left join joined j using (doc_id)
"""
)


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written as grammar shards in ascending doc_id order and read back."""
    return grammar.encode_and_read_back(table(spark, sf_dir, "documents"))


def op11_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the leading components of their distinct vectors' covariance, with unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_exponential_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix by source weights takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE_12 = r"""
with own as (
  select doc_id, source, coalesce(text, '') as text from documents
), drawn as (
  select doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as size, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as ink,
    length(regexp_replace(text, '[^\p{L}]+', '', 'g')) as letters,
    (cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || text), 1, 12) as bigint) + 0.5) / 281474976710656 as u
  from own
), keyed as (
  select *, -ln(u) / least(1, greatest(1.0 / 1024, case when ink > 0 then letters / ink else 1 end)) as key from drawn
), sources as (
  select source, sum(size) as source_size, 2.0 * sum(size) as most, [3, 1, 2][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight
  from keyed group by source
), held as (  -- by how soon a source is full; the first that isn't sets the rate
  select *, (1.5 * sum(source_size) over () - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as rate from sources
), goal as (
  select source, source_size, least(most, weight * coalesce((select max(rate) from held where most > weight * rate), 1e300)) as target from held
), parts as (
  select k.*, g.source_size, g.target, case when g.source_size > 0 then floor(g.target / g.source_size) else 0 end as whole,
    sum(size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and current row) - size as before
  from keyed k join goal g on k.source is not distinct from g.source
)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, cast(target as double) as target,
  cast(whole * size + least(size, greatest(0, floor(target - whole * source_size + 0.5) - before)) as bigint) as taken
from parts
"""


def op13_contracted_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each with up to three turns of the conversation it branches from."""
    conv = F.col("conv_id")
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), base=conv - conv % 20, head=F.pmod(F.crc32(conv.cast("string")), F.lit(4)))


ORACLE_13 = """
with recursive own as (
  select conv_id, list(coalesce(role, '') || chr(10) || coalesce(text, '') order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns,
    list(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as sizes
  from conversations where conv_id is not null group by conv_id
), crc(conv_id, step, value) as (  -- bit by bit
  select conv_id, 0, cast(4294967295 as bigint) from own
  union all
  select conv_id, step + 1, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end
  from (select conv_id, step, case when step % 8 = 0 then xor(value, cast(ascii(substr(cast(conv_id as varchar), step // 8 + 1, 1)) as bigint)) else value end as v
    from crc where step < 8 * length(cast(conv_id as varchar)))
), heads as (
  select conv_id, xor(value, 4294967295) % 4 as h from crc where step = 8 * length(cast(conv_id as varchar))
), rebuilt as (
  select o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) as turns, list_concat(coalesce(b.sizes[1:h], []), o.sizes[h + 1:]) as sizes
  from own o join heads using (conv_id) left join own b on b.conv_id = o.conv_id - o.conv_id % 20
), places as (
  select conv_id, unnest(range(0, len(turns) + 1)) as depth, turns, sizes from rebuilt
), named as (
  select conv_id, depth, md5(cast(turns[1:depth] as varchar)) as key, case when depth > 0 then md5(cast(turns[1:depth - 1] as varchar)) end as up,
    case when depth > 0 then sizes[depth] else 0 end as size, len(turns) = depth as ends from places
), nodes as (
  select depth, key, min(conv_id) as conv_id, min(up) as up, count(*) as n_convs, max(size) as size, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends) as ids
  from named group by depth, key
), kids as (
  select depth - 1 as depth, up as key, count(*) as n from nodes where depth > 0 group by all
), full_ as (
  select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k using (depth, key)
), above as (  -- each node below each of its ancestors, by way of its smallest member
  select f.depth, f.key, a.depth as top, a.key as top_key from full_ f join named a on a.conv_id = f.conv_id and a.depth <= f.depth
), sums as (
  select top as depth, top_key as key, count(*) filter (f.n_children = 0) as n_leaves, cast(sum((f.n_convs - 1) * f.size) as bigint) as saved_tokens
  from above join full_ f using (depth, key) group by all
)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(f.ids, '')) as ends_sha256
from full_ f join sums s using (depth, key) left join full_ p on p.depth = f.depth - 1 and p.key = f.up
"""


QUERIES = {
    "op4_template_windows": op4_template_windows,
    "op1_counterfactual_toxicity": op1_counterfactual_toxicity,
    "op2_language_mixture": op2_language_mixture,
    "op5_cascade_rules": op5_cascade_rules,
    "op7_blob_ledger": op7_blob_ledger,
    "op3_typed_content_parts": op3_typed_content_parts,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op8_simhash_pigeonring": op8_simhash_pigeonring,
    "op9_bradley_terry": op9_bradley_terry,
    "op10_repair_grammar": op10_repair_grammar,
    "op11_spectral_whitening": op11_spectral_whitening,
    "op12_exponential_mixing": op12_exponential_mixing,
    "op13_contracted_trie": op13_contracted_trie,
    "chat_attachments": chat_attachments,
}

ORACLES = {
    "op5_cascade_rules": ORACLE_5,
    "op7_blob_ledger": ORACLE_7,
    "op3_typed_content_parts": ORACLE_3,
    "op12_exponential_mixing": ORACLE_12,
    "op13_contracted_trie": ORACLE_13,
    "chat_attachments": ORACLE_ATTACHMENTS,
}
