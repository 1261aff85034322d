"""Queries p6 to p9 over the text tables, and their SQL where SQL can express them."""

import secrets

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm.leakage import leaked_items, without_leaks
from factloom.llm.packing import audit, fill, pack
from factloom.llm.pii import personal_data, redacted
from factloom.llm.sentences import sentence_spans, sentence_texts
from factloom.llm.tokens import token_counts
from factloom.scratch import cut
from factloom.sources.tables import table

#: The stock prompts of the held-out items.
PROMPTS = ("阅读下面的材料并作答。", "Read the passage and answer briefly. ")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, i, x: table(spark, d, t).select(F.lit(t).alias("source_table"), F.col(i).alias("record_id"), F.col(x).alias("text"))
    return one("anchors", "anchor_id", "text").unionByName(one("fact_candidate", "fact_candidate_id", "assertion_text"))


def _key(spark: SparkSession) -> str:
    """The secret of the pseudonyms: the session's factloom.pii.key, or a new one, so that nobody can turn them back."""
    return spark.conf.get("factloom.pii.key", None) or secrets.token_hex(32)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_data(_texts(spark, d), key=_key(spark)).select("source_table", "record_id", "pii_type", "start_char", "end_char").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(_texts(spark, d), key=_key(spark))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each record outside its placeholders, and those of its mentions: together all of its text."""
    texts, key = _texts(spark, d).where(F.col("text").isNotNull()), _key(spark)
    rest = F.regexp_replace("text", r"\[(EMAIL|PHONE|NAME|ADDRESS|IDENTITY):[^\]]*\]", "")
    parts = redacted(texts, key=key).select("source_table", "record_id", F.length(rest).alias("n"))
    parts = parts.unionByName(personal_data(texts, key=key).select("source_table", "record_id", (F.col("end_char") - F.col("start_char")).alias("n")))
    return parts.groupBy("source_table", "record_id").agg(F.sum("n").alias("characters"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents")))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(p7_containers(spark, d))


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(token_counts(table(spark, d, "documents")))
    return audit(pack(sizes), sizes)


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "test_items"), prompts=PROMPTS)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id").distinct()


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d)


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_leaks(table(spark, d, "documents").select("doc_id", "source", "n_chars"), cut(_leaked(spark, d)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_spans(table(spark, d, "documents"))


def p9_characters(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document's sentences without white space: all those of its text."""
    found = sentence_texts(table(spark, d, "documents"))
    return found.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("sentence", r"(?U)[\s\x1c-\x1f]", ""))).alias("characters"))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """Items that stand in a document letter by letter."""
    return _leaked(spark, d).where(F.col("longest") == F.col("item_chars")).select("doc_id", "item_id").distinct()


QUERIES = {f.__name__: f for f in (p6_found, p6_redacted, p6_kept, p7_containers, p7_fill, p7_audit, p8_found, p8_matches, p8_clean, p8_whole, p9_found, p9_characters)}
_BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
#: Full-width letters and digits, and what they stand for.
_WIDE = "".join(chr(c) for c in range(0xFF10, 0xFF5B) if chr(c).isalnum())
_FLAT = rf"regexp_replace(lower(translate(nfc_normalize({{0}}), '{_WIDE}', '{''.join(chr(ord(c) - 0xFEE0) for c in _WIDE)}')), '[^\p{{{{L}}}}\p{{{{N}}}}]', '', 'g')"
#: What SQL can tell of the text operators: that nothing is lost, and leaks that are letter by letter.
SQL: dict[str, str] = {
    "p6_kept": """
select source_table, record_id, sum(length(text))::bigint as characters from (
  select 'anchors' as source_table, anchor_id as record_id, text from anchors union all select 'fact_candidate', fact_candidate_id, assertion_text from fact_candidate)
where text is not null group by all""",
    "p7_audit": "select doc_id, true as covered, true as within_capacity, true as split_only_if_longer from documents where text <> ''",
    "p8_whole": f"""
with i as (select item_id, {_FLAT.format("case when starts_with(text, '" + PROMPTS[0] + "') then text[length('" + PROMPTS[0] + "') + 1:] when starts_with(text, '" + PROMPTS[1] + "') then text[length('" + PROMPTS[1] + "') + 1:] else text end")} as x from test_items)
select distinct doc_id, item_id from (select doc_id, {_FLAT.format('text')} as t from documents) d join i on contains(d.t, i.x) where i.x <> ''""",
    "p9_characters": f"select doc_id, length(regexp_replace(text, '{_BLANK}', '', 'g'))::bigint as characters from documents where regexp_replace(text, '{_BLANK}', '', 'g') <> ''",
}
