"""Queries over the text corpus: cleaning, chunking and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tephra.functions import text as t
from tephra.operators import chunking, evaluation, retrieval
from tephra.sources import tables

NATION_NAMES = {f"N{k}": f"Nation {k}" for k in range(25)}


def clean_pages(spark, sf_dir):
    pages = chunking.pages_of(tables.corpus_pages(spark, sf_dir))
    return pages.select("source", "page", F.length("text").alias("n"), F.md5("text").alias("digest"))


def unmappable_pages(spark, sf_dir):
    """Cleaning of pages in which glyphs could not be mapped: every third page loses some vowels, the next one its e's."""
    bad = t.UNMAPPABLE
    text = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeiu", bad * 4)).when(
        F.col("doc_id") % 3 == 1, F.replace("text", F.lit("e"), F.lit(bad))
    ).otherwise(F.col("text"))
    pages = tables.corpus_pages(spark, sf_dir).withColumn("text", text)
    return chunking.pages_of(pages).select("source", "page", F.length("text").alias("n"), F.md5("text").alias("digest"))


def tokenize_docs(spark, sf_dir):
    words = t.tokens("text")
    return tables.read(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select(
        "doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"),
        F.md5(F.array_join("w", " ")).alias("digest")
    )


def term_stats(spark, sf_dir):
    return retrieval.term_statistics(tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text"))


def _lexical(spark, sf_dir, k):
    docs = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    return retrieval.bm25(docs, tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), k)


def _searched(spark, sf_dir, k):
    """Rankings of every vector whose id is divisible by 20, against all vectors."""
    v = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    return retrieval.cosine(v, v.where("ord % 20 = 0").withColumnRenamed("ord", "qid"), k)


def _semantic(spark, sf_dir, k):
    """The same rankings as those of questions: the n-th query vector stands for question n."""
    return _searched(spark, sf_dir, k).withColumn("qid", F.expr("qid div 20"))


def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir, 10).select("qid", "ord", "rank", F.round("score", 6).alias("score"))


def dense_topk(spark, sf_dir):
    return _searched(spark, sf_dir, 10).select("qid", "ord", "rank", F.round("score", 6).alias("score"))


def rrf_hybrid(spark, sf_dir):
    return retrieval.fuse(
        [_lexical(spark, sf_dir, 50), _semantic(spark, sf_dir, 50)], 10
    ).select("qid", "ord", "rank", F.round("score", 6).alias("score"))


def retrieve_fallback(spark, sf_dir):
    return retrieval.retrieve(_lexical(spark, sf_dir, 50), _semantic(spark, sf_dir, 50), 5)


def _rankings(spark, sf_dir):
    """(retriever, qid, source, page, rank) of the three retrievers at one depth."""
    lexical, semantic = _lexical(spark, sf_dir, 50), _semantic(spark, sf_dir, 50)
    runs = {"bm25": lexical, "dense": semantic, "hybrid": retrieval.fuse([lexical, semantic], 50)}
    out = None
    for name, r in runs.items():
        part = r.select(F.lit(name).alias("retriever"), "qid", "ord", "rank")
        out = part if out is None else out.unionByName(part)
    pages = tables.corpus_pages(spark, sf_dir).select(F.col("doc_id").alias("ord"), "source", "page")
    return retrieval.page_ranking(pages.join(out, "ord"), ["retriever", "qid"])


def page_dedupe(spark, sf_dir):
    return _rankings(spark, sf_dir).where("rank <= 10")


def _gold_ranks(spark, sf_dir):
    ranks = evaluation.first_gold_rank(_rankings(spark, sf_dir), tables.benchmark_gold(spark, sf_dir), ["retriever", "qid"])
    return ranks.withColumn("slice", F.concat(F.lit("s"), F.col("qid") % 7))


def recall_at_k(spark, sf_dir):
    ranks = _gold_ranks(spark, sf_dir)
    both = ranks.unionByName(ranks.withColumn("slice", F.lit("HEADLINE")))
    return evaluation.recall_report(both, ["retriever", "slice"])


def mrr_by_slice(spark, sf_dir):
    return _gold_ranks(spark, sf_dir).groupBy("retriever", "slice").agg(
        F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr")
    )


def table_rows(spark, sf_dir):
    found = tables.table_pages(spark, sf_dir).select(
        "source", "page",
        F.posexplode(chunking.segments(F.col("text"), chunking.region_pattern(NATION_NAMES))).alias("i", "s")
    )
    return found.select("source", "page", "i", "s.label", F.md5("s.text").alias("digest"))


def caption_carry(spark, sf_dir):
    return chunking.with_captions(
        tables.table_pages(spark, sf_dir), chunking.region_pattern(NATION_NAMES)
    ).select("source", "page", "caption")


def chunk_windows(spark, sf_dir):
    chunks = chunking.chunk_pages(tables.cleaned_pages(spark, sf_dir).select("source", "page", "text"))
    return chunks.select("chunk_id", "source", "page", F.length("text").alias("n"), F.md5("text").alias("digest"))


def chunk_tables(spark, sf_dir):
    chunks = chunking.chunk_pages(tables.table_pages(spark, sf_dir), chunking.region_pattern(NATION_NAMES))
    return chunks.select("chunk_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


def quote_check(spark, sf_dir):
    items = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), t.clean_text("text").alias("item"))
    gold = tables.benchmark_gold(spark, sf_dir).join(retrieval.small(items), "qid")
    pages = tables.cleaned_pages(spark, sf_dir).select("source", "page", "text").join(
        retrieval.small(gold), ["source", "page"]
    )
    quote = t.quote_between("text", F.left("item", F.lit(20)), F.right("item", F.lit(15)), 600)
    return pages.select("qid", "source", "page", F.md5(quote).alias("quote"), F.contains("text", "item").alias("verbatim"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_pages, unmappable_pages, tokenize_docs, term_stats, bm25_topk, dense_topk, rrf_hybrid, retrieve_fallback,
        page_dedupe, recall_at_k, mrr_by_slice, table_rows, caption_carry, chunk_windows, chunk_tables, quote_check
    )
}

_CLEAN = r"trim(regexp_replace(replace(regexp_replace(text, '(\w)-\s*\n\s*(\w)', '\1\2', 'g'), chr(65533), ' '), '\s+', ' ', 'g'))"
_PAGES = f"pages as (select doc_id, source, page, {_CLEAN} as text from (select doc_id, source, row_number() over (partition by source order by doc_id)::int as page, text from documents) where {_CLEAN} <> '')"
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _lexical_sql(docs: str = "documents", asked: str = "(select item_id as qid, text from benchmark)") -> str:
    """BM25 rankings ``lex`` of these questions (qid, text) over these texts (doc_id, text)."""
    return f"""
toks as (select doc_id as ord, {_TOKENS} as w from {docs}),
tot as (select count(*) as n, avg(len(w)) as mean from toks),
post as (select ord, dl, term, count(*) as tf from (select ord, len(w) as dl, unnest(w) as term from toks) group by all),
df as (select term, count(*) as df from post group by term),
asked as (select qid, term, count(*) as qtf from (select qid, unnest({_TOKENS}) as term from {asked}) group by all),
lex_all as (select qid, ord, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))), 9) as score
  from asked join post using (term) join df using (term), tot group by qid, ord),
lex as (select *, row_number() over (partition by qid order by score desc, ord) as rank from lex_all)"""


_LEXICAL = _lexical_sql()
_SEMANTIC = """
vec as (select vec_id as ord, embedding::double[] as e from embeddings),
unit as (select ord, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) as e from vec),
sem_all as (select q.ord as qid, d.ord as ord, round(list_dot_product(q.e, d.e), 9) as score from unit q, unit d where q.ord % 20 = 0),
searched as (select *, row_number() over (partition by qid order by score desc, ord) as rank from sem_all),
sem as (select qid // 20 as qid, ord, score, rank from searched)"""
_FUSED = """
both_r as (select qid, ord, rank, rank as r0, null::bigint as r1 from lex where rank <= 50 union all select qid, ord, rank, null, rank from sem where rank <= 50),
fused as (select qid, ord, score, row_number() over (partition by qid order by score desc, r0 nulls last, r1 nulls last, ord) as rank
  from (select qid, ord, round(sum(1.0::double / (60 + rank)), 9) as score, min(r0) as r0, min(r1) as r1 from both_r group by qid, ord))"""
_RANKED = f"""{_LEXICAL}, {_SEMANTIC}, {_FUSED}, {_PAGES},
runs as (select 'bm25' as retriever, qid, ord, rank from lex where rank <= 50 union all select 'dense', qid, ord, rank from sem where rank <= 50 union all select 'hybrid', qid, ord, rank from fused where rank <= 50),
firsts as (select retriever, qid, source, page, min(rank) as first from runs join (select doc_id as ord, source, row_number() over (partition by source order by doc_id)::int as page from documents) using (ord) group by all),
ranked as (select retriever, qid, source, page, row_number() over (partition by retriever, qid order by first, source, page) as rank from firsts),
gold as (select distinct item_id as qid, source, page from (select item_id, {_CLEAN} as item from benchmark) join pages on contains(pages.text, item)),
asked_r as (select distinct retriever, g.qid from ranked, (select distinct qid from gold) g),
best as (select retriever, qid, min(rank) as r from ranked join gold using (qid, source, page) group by all),
first_rank as (select a.retriever, a.qid, 's' || (a.qid % 7) as slice, r from asked_r a left join best using (retriever, qid))"""
_TABLES = """
nrow as (select n_regionkey, n_nationkey, 'Nation ' || n_nationkey || ' (N' || n_nationkey || ') ' || repeat(n_name || ' projected change ', 20 + n_nationkey * 3) as row from nation),
nrows as (select n_regionkey, string_agg(row, '' order by n_nationkey) as rows from nrow group by 1),
tp as (select 'T' || r_regionkey as source, page, trim(case page when 1 then 'Table 1.' || r_regionkey || ' | Observed trends of ' || r_name || ' at two levels | ' || rows when 3 then 'Prose about ' || r_name else rows end) as text
  from region join nrows on r_regionkey = n_regionkey, (select unnest([1, 2, 3, 4])::int as page) p),
labelled as (select *, regexp_extract_all(text, 'Nation[\\s\\-/]+[0-9]+\\s*\\(N[0-9]+\\)') as labels, regexp_split_to_array(text, 'Nation[\\s\\-/]+[0-9]+\\s*\\(N[0-9]+\\)') as between from tp),
seg as (select source, page, i - 2 + (case when trim(between[1]) <> '' then 1 else 0 end) as i, case when i > 1 then labels[i - 1] end as label, trim(case when i > 1 then labels[i - 1] || between[i] else between[1] end) as text
  from (select *, unnest(range(1, len(between) + 1)) as i from labelled where len(labels) >= 2) where i > 1 or trim(between[1]) <> ''),
cap as (select source, page, len(labels) >= 2 as is_table, trim(regexp_extract(text, 'Table [0-9]+\\.[0-9]+\\s*\\|\\s*[^|]{0,160}')) as raw from labelled),
own as (select *, case when is_table and raw <> '' then regexp_replace(raw, ' [^ ]*$', '') end as own, sum(case when is_table then 0 else 1 end) over (partition by source order by page) as run from cap),
carried as (select source, page, case when is_table then last_value(own ignore nulls) over (partition by source, run order by page rows unbounded preceding) end as caption from own)"""


def _windows(source: str) -> str:
    """Recursive windows over rows (key columns k, text) of ``source``; columns k, no, piece."""
    return f"""
win as (
  select k, text, 0 as s, 0 as no, case when length(text) <= 1200 then length(text) else case when strpos(substr(text, 2, 1199), ' ') > 0 then 1200 - strpos(reverse(substr(text, 2, 1199)), ' ') else 1200 end end as e, length(text) <= 1200 as whole from {source} where text <> ''
  union all
  select k, text, ns, no + 1,
    case when ns + 1200 >= length(text) then length(text) when strpos(substr(text, ns + 2, 1199), ' ') > 0 then ns + 1200 - strpos(reverse(substr(text, ns + 2, 1199)), ' ') else ns + 1200 end, false
  from (select *, case when nx > s then nx else e + 1 end as ns from (
    select *, case when strpos(substr(text, s + 1, c - s), ' ') > 0 then c - strpos(reverse(substr(text, s + 1, c - s)), ' ') + 1 else c end as nx
    from (select *, case when e - 150 <= s then e else e - 150 end as c from win where e < length(text)))) where ns < length(text)),
pieces as (select k, case when whole then text else trim(substr(text, s + 1, e - s)) end as piece, no from win)"""


ORACLES = {
    "clean_pages": f"with {_PAGES} select source, page, length(text) as n, md5(text) as digest from pages",
    "unmappable_pages": f"""with raw as (select source, row_number() over (partition by source order by doc_id)::int as page, case doc_id % 3 when 0 then translate(text, 'aeiu', repeat(chr(65533), 4)) when 1 then replace(text, 'e', chr(65533)) else text end as text from documents),
kept as (select * from raw where not coalesce(length(text) > 0 and length(text) - length(replace(text, chr(65533), '')) > 0.2 * length(text), false))
select source, page, length(c) as n, md5(c) as digest from (select source, page, {_CLEAN} as c from kept) where c <> ''""",
    "tokenize_docs": f"select doc_id, len(w) as n_tokens, len(list_distinct(w)) as n_distinct, md5(array_to_string(w, ' ')) as digest from (select doc_id, {_TOKENS} as w from documents)",
    "term_stats": f"select term, count(*) as df, sum(tf)::bigint as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOKENS}) as term from documents) group by all) group by term",
    "bm25_topk": f"with {_LEXICAL} select qid, ord, rank, round(score, 6) as score from lex where rank <= 10",
    "dense_topk": f"with {_SEMANTIC} select qid, ord, rank, round(score, 6) as score from searched where rank <= 10",
    "rrf_hybrid": f"with {_LEXICAL}, {_SEMANTIC}, {_FUSED} select qid, ord, rank, round(score, 6) as score from fused where rank <= 10",
    "retrieve_fallback": f"with {_LEXICAL}, {_SEMANTIC}, {_FUSED} select qid, ord, rank, 'hybrid' as retrieval_mode from fused where rank <= 5 and qid in (select qid from sem) union all select qid, ord, rank, 'bm25_only' from lex where rank <= 5 and qid not in (select qid from sem)",
    "page_dedupe": f"with {_RANKED} select * from ranked where rank <= 10",
    "recall_at_k": f"""with {_RANKED},
f as (select * from first_rank union all select retriever, qid, 'HEADLINE', r from first_rank),
c as (select retriever, slice, count(*)::double as n, count(*) filter (where r <= 3)::double as h3, count(*) filter (where r <= 5)::double as h5, count(*) filter (where r <= 10)::double as h10, avg(coalesce(1.0::double / r, 0)) as mrr from f group by all)
select retriever, slice, n::bigint as n, """
    + ", ".join(
        f"round(h{k} / n, 4) as recall_{k}, round((h{k} / n + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(h{k} / n * (1 - h{k} / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 4) as low_{k}, round((h{k} / n + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(h{k} / n * (1 - h{k} / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 4) as high_{k}"
        for k in (3, 5, 10)
    )
    + ", round(mrr, 4) as mrr from c",
    "mrr_by_slice": f"with {_RANKED} select retriever, slice, round(avg(coalesce(1.0::double / r, 0)), 6) as mrr from first_rank group by all",
    "table_rows": f"with {_TABLES} select source, page, i, label, md5(text) as digest from seg",
    "caption_carry": f"with {_TABLES} select source, page, caption from carried",
    "chunk_windows": f"with recursive {_PAGES}, src as (select source || '#p' || page as k, source, page, text from pages), {_windows('src')} select k || '#' || (row_number() over (partition by k order by no) - 1) as chunk_id, split_part(k, '#', 1) as source, substr(split_part(k, '#', 2), 2)::int as page, length(piece) as n, md5(piece) as digest from pieces where piece <> ''",
    "chunk_tables": f"""with recursive {_TABLES},
src as (select source || '#p' || page || '#' || i as k, text from (select source, page, i, text from seg union all select source, page, 0, text from labelled where len(labels) < 2)), {_windows('src')},
lab as (select split_part(k, '#', 1) as source, substr(split_part(k, '#', 2), 2)::int as page, split_part(k, '#', 3)::int as i, no, piece from pieces where piece <> ''),
full_ as (select l.source, l.page, l.i, no, label, caption, case when label is not null and not starts_with(piece, label) then label || ' ' || piece else piece end as p from lab l left join seg s on s.source = l.source and s.page = l.page and s.i = l.i left join carried c on c.source = l.source and c.page = l.page),
done as (select *, case when label is not null and caption is not null and not contains(p, 'Table') then p || ' [' || caption || ']' else p end as text from full_)
select source || '#p' || page || '#' || (row_number() over (partition by source, page order by i, no) - 1) as chunk_id, length(text) as n, md5(text) as digest from done""",
    "quote_check": f"""with {_PAGES}, it as (select item_id as qid, {_CLEAN} as item from benchmark),
g as (select qid, source, page, text, item, left(item, 20) as a, right(item, 15) as b from it join pages on contains(text, item)),
p as (select *, strpos(text, a) as s from g), q as (select *, substr(text, s) as rest from p),
r as (select *, strpos(substr(rest, length(a) + 1), b) as e from q)
select qid, source, page, case when s > 0 and e > 0 and length(a) + e + length(b) - 1 <= 600 then md5(left(rest, length(a) + e + length(b) - 1)) end as quote, true as verbatim from r""",
}
