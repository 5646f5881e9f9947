"""Named queries of the operators in this folder, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import (
    bpe,
    decontaminate,
    factor_spans,
    filter_audit,
    fim,
    fingerprints,
    html_extract,
    license_scan,
    lines,
    quality,
    secret_scan,
    simhash,
    warc,
)
from lodegraph.llm.common import stored, table
from lodegraph.session import scratch_folder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    ids = bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"])
    return bpe.decode(ids, ranks).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that at least five documents share, dropped from all but the last of them."""
    kept = lines.drop_frequent_lines(table(spark, folder, "documents"), ["doc_id"], min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


CHECKS["op3_line_dedup"] = """
with split_lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
    from documents
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
    from split_lines
), frequent as (
    select line_key, max(doc_id) as last_doc from keyed where length(line_key) >= 40
    group by line_key having count(distinct doc_id) >= 5
), judged as (
    select k.*, f.line_key is not null and k.doc_id <> f.last_doc as dropped
    from keyed k left join frequent f using (line_key)
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '')) as kept_sha256
from judged group by doc_id
"""


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents whose fingerprints differ in two bits or less."""
    classes = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, bits=2, blocks=4, equal=2)
    return classes.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages that documents hold, with up to one edit in ten characters."""
    return decontaminate.passages_in(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents, and whether they are kept."""
    scored = quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])
    return scored.withColumn("keep", F.col("score") >= 0.5)


@query
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how near these are."""
    return fingerprints.fingerprint_versions(table(spark, folder, "documents"))


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Places of secrets in all documents."""
    found = secret_scan.scan(table(spark, folder, "documents"), ["doc_id"])
    return found.select(
        "doc_id",
        *(secret_scan.count_of("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secret_scan.written("base"), 256).alias("base_sha256"),
        secret_scan.written("spans").alias("spans"),
    )


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as archives and read back."""
    path = scratch_folder(spark, "warc")
    pages = table(spark, folder, "pages")
    payload = F.coalesce("html", F.lit("")).cast("binary").alias("_html")
    typed = warc.assign_types(pages.select("page_id", "url", payload), "page_id", "_html")
    warc.write(typed, path, "page_id", "url", "_html")
    found = stored(warc.read(spark, path).drop("payload", "target"), "warc-records")
    fault = F.col("error").isNotNull()
    return warc.with_referred_lengths(found).select(
        F.col("key").alias("page_id"),
        "payload_bytes",
        F.when(fault, F.raise_error(F.col("error")).cast("string")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


CHECKS["op7_warc"] = """
with payloads as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
    from pages
), compared as (
    select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as last_page
    from payloads
)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when page_id < last_page then 'revisit' else 'response' end as record_type,
       case when page_id < last_page then last_page end as refers_to
from compared
"""


@query
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices of all documents, best first; a document without any has one row without a licence."""
    found = license_scan.scan(table(spark, folder, "documents"), ["doc_id"])
    return found.select("doc_id", F.explode_outer("notices").alias("x")).select("doc_id", "x.*")


def _license_check() -> str:
    """The same over all runs between bigrams of a template, without anchors."""
    rows, least = [], license_scan.LEAST
    for place, (name, text) in enumerate(license_scan.TEMPLATES):
        bigrams = license_scan.bigrams_of(text)
        listed = ", ".join(f"'{b}'" for b in bigrams)
        size = len(bigrams)
        rows.append(f"({place}, '{name}', [{listed}], {size * least / (2 - least)!r}, {size * (2 - least) / least!r})")
    return f"""
with templates(template, license, bigrams, low, high) as (values {", ".join(rows)}
), lines as (
    select doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) as line,
           generate_subscripts(string_split(lower(coalesce(text, '')), chr(10)), 1) - 1 as place
    from documents
), worded as (
    select doc_id, place, list_filter(string_split(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),
                                      lambda w: w <> '') as words
    from lines
), words as (
    select doc_id, place, generate_subscripts(words, 1) as k, unnest(words) as word from worded
), ordered as (
    select doc_id, place, word, row_number() over (partition by doc_id order by place, k) as spot from words
), pairs as (
    select doc_id, spot, word || ' ' || lead(word) over w as pair, place as first_line, lead(place) over w as last_line
    from ordered window w as (partition by doc_id order by spot)
), marks as (
    select doc_id, spot, first_line, last_line, template,
           row_number() over (partition by doc_id, template order by spot) as mark
    from pairs join (select template, unnest(bigrams) as pair from templates) using (pair)
), runs as (
    select a.doc_id, template, a.spot as a, b.spot as b, a.first_line, b.last_line
    from marks a join marks b using (doc_id, template) join templates t using (template)
    where b.spot >= a.spot and b.spot - a.spot + 1 <= t.high and b.mark - a.mark + 1 >= t.low
), compared as (
    select r.doc_id, license, first_line, last_line,
           round(2.0 * count(distinct pair) filter (list_contains(bigrams, pair)) / (count(distinct pair) + len(bigrams)), 9) as dice
    from (select doc_id, template, a, b, first_line, last_line from runs) r
    join (select doc_id, spot, pair from pairs) p on p.doc_id = r.doc_id and p.spot between r.a and r.b
    join templates using (template)
    group by r.doc_id, template, license, bigrams, a, b, first_line, last_line
), best as (
    select doc_id, license, dice, first_line, last_line from compared where dice >= {least}
    qualify row_number() over (partition by doc_id, license order by dice desc, first_line, last_line) = 1
)
select doc_id, license, dice, first_line::int as first_line, last_line::int as last_line
from documents left join best using (doc_id)
"""


CHECKS["op9_licenses"] = _license_check()


@query
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    found = html_extract.extract(table(spark, folder, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents rearranged for filling in the middle, and restored."""
    moved = fim.rearranged(table(spark, folder, "documents"), ["doc_id"], seed=7, share=100, spm=50)
    return moved.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"),
    )


CHECKS["op11_fill_in_middle"] = """
with texts as (
    select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as digest from documents
), counted as (
    select doc_id, text, string_split(text, chr(10)) as parts,
           ('0x' || digest[1:8])::bigint as h1, ('0x' || digest[9:16])::bigint as h2,
           ('0x' || digest[25:32])::bigint as h4,
           case when text = '' then 0 when text[-1] = chr(10) then len(parts) - 1 else len(parts) end as n
    from texts
), placed as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
           text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') as plain
    from counted
), ends as (
    select *, least(coalesce(list_sum(list_transform(parts[1:a], lambda x: length(x) + 1)), 0), length(text)) as p,
           least(coalesce(list_sum(list_transform(parts[1:b], lambda x: length(x) + 1)), 0), length(text)) as m
    from placed
), pieces as (
    select *, substr(text, 1, p::bigint) as prefix, substr(text, p::bigint + 1, (m - p)::bigint) as middle,
           substr(text, m::bigint + 1) as suffix
    from ends
)
select doc_id, n::bigint as n, case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
       case when not plain then p::bigint end as prefix_chars, case when not plain then (m - p)::bigint end as middle_chars,
       sha256(case when plain then text
                   when h4 % 100 < 50 then '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from pieces
"""


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from each language, in every order."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


CHECKS["op13_filter_audit"] = """
with texts as (
    select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words
    from documents
), failing as (
    select t.part,
           {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
            'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
            'D': regexp_matches(text, '[#$%&*|]'),
            'E': doc_id > min(doc_id) over (partition by text)} as f,
           doc_id in (select doc_id from labels where quality = 1) as good,
           doc_id in (select doc_id from labels where toxic = 1) as toxic
    from texts t
), letters(letter) as (values ('A'), ('B'), ('C'), ('D'), ('E')
), orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
    from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), sets as (
    select part, (case when f['A'] then 'A' else '' end) || (case when f['B'] then 'B' else '' end)
                 || (case when f['C'] then 'C' else '' end) || (case when f['D'] then 'D' else '' end)
                 || (case when f['E'] then 'E' else '' end) as failed,
           count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic
    from failing group by all
), judged as (
    select part, filter_order, step, n, n_good, n_toxic, failed,
           contains(failed, filter_order[step]) as here,
           translate(failed, filter_order[1:step - 1], '') <> failed as gone
    from sets, orders, range(1, 6) steps(step)
), steps as (
    select part, filter_order, step::int as step,
           coalesce(sum(n) filter (not here and not gone), 0)::bigint as kept,
           coalesce(sum(n) filter (here and not gone), 0)::bigint as removed,
           coalesce(sum(n) filter (here and gone), 0)::bigint as redundant,
           coalesce(sum(n) filter (failed = filter_order[step]), 0)::bigint as unique_fails,
           coalesce(sum(n_good) filter (here and not gone), 0)::bigint as good_lost,
           coalesce(sum(n_toxic) filter (here and not gone), 0)::bigint as toxic_lost
    from judged group by all
)
select *, (sum(removed) over (partition by part, filter_order[step]))::bigint as shapley from steps
"""


@query
def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents in runs of 13 that a document with a smaller id holds, removed."""
    kept = factor_spans.remove_repeats(table(spark, folder, "documents"), ["doc_id"], window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


CHECKS["op12_substring_dedup"] = """
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), placed as (
    select doc_id, unnest(range(1, len(words) + 1)) as place, unnest(words) as word, words from words
), runs as (
    select doc_id, place, word,
           case when place + 12 <= len(words) then array_to_string(words[place:place + 12], ' ') end as run
    from placed
), judged as (
    select doc_id, place, word,
           run is not null and doc_id > min(doc_id) over (partition by run) as shared
    from runs
), covered as (
    select doc_id, place, word,
           bool_or(shared) over (partition by doc_id order by place rows between 12 preceding and current row) as gone
    from judged
), kept as (
    select doc_id, count(*) filter (gone) as n_removed,
           coalesce(string_agg(word, ' ' order by place) filter (not gone), '') as kept
    from covered group by doc_id
)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from words left join kept using (doc_id)
"""
