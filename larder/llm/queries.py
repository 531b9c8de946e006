"""The registered queries of the training-text operators, and their SQL where there is one."""

from pyspark.sql import functions as F

from larder.llm import (
    decontaminate,
    language_model,
    licenses,
    lines,
    mixing,
    negatives,
    revisits,
    simhash,
    tokens,
    topk,
    toxicity,
    urls,
    whitening,
)

QUERIES = {}
ORACLES = {}

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def register(sql=None):
    def add(query):
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register()
def op1_token_output(spark, sf_dir):
    return tokens.encoded(table(spark, sf_dir, "documents"), tokenizer_path())


OP2_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as key
  from documents),
by_source as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as source_id from by_source),
capped as (select *, source_id % 3 + 1 as weight, source_size * 3 as cap from ranked),
levels as (
  select *, (sum(source_size) over ()
             - coalesce(sum(cap) over (order by cap / weight, source_id rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, source_id rows between current row and unbounded following) as own_level
  from capped),
level as (select *, max(case when own_level * weight <= cap then own_level end) over () as level from levels),
targets as (select source, source_id, source_size, coalesce(least(cap::double, level * weight), 0) as target from level),
shares as (
  select *, floor(target + 0.5)::bigint as words,
         coalesce(sum(target) over (order by source_id rows between unbounded preceding and 1 preceding) / nullif(sum(target) over (), 0), 0) as lo,
         case when source_id = max(source_id) over () then 1.0::double
              else coalesce(sum(target) over (order by source_id rows between unbounded preceding and current row) / nullif(sum(target) over (), 0), 0) end as hi
  from targets),
scale as (
  select greatest(0, ceil(log2(greatest(sum(size), 1)::double / 128)))::int as bits, greatest(sum(size), 1)::double as words from sized),
grid as (select bits, (1 << bits)::bigint as n, words / (1 << bits) as block from scale),
points as (
  select i as slot, coalesce(list_sum(list_transform(range(bits), lambda b: ((i >> b) & 1) << (bits - 1 - b))), 0) as point
  from grid, range((select n from grid)) t(i)),
spans as (
  select s.*, case when ceil(lo * n) >= ceil(hi * n) then least(floor(lo * n), n - 1) else lo * n end as x,
         case when ceil(lo * n) >= ceil(hi * n) then least(floor(lo * n), n - 1) + 1 else hi * n end as y
  from shares s, grid),
scheduled as (select *, (ceil(y) - ceil(x))::bigint as n_slots from spans),
slots as (
  select slot, source_id, row_number() over (partition by source_id order by slot) - 1 as rank
  from points join scheduled on point >= x and point < y where words > 0),
placed as (
  select doc_id, size, source_id, s.source_size, target, words, n_slots,
         (sum(size) over (partition by source_id order by key, doc_id rows between unbounded preceding and current row) - size)::bigint as start
  from sized join scheduled s on sized.source is not distinct from s.source),
readings as (
  select source_id, doc_id, start, words, n_slots, epoch, epoch * source_size + start as begins,
         least(epoch * source_size + start + size, words) as ends
  from placed, lateral unnest(range((words - 1 - start) // source_size + 1)) t(epoch)
  where size > 0 and start < words),
ranked_readings as (
  select r.*, rank, block
  from readings r, grid,
       lateral unnest(range(least(greatest(floor(begins / block)::bigint - 1, 0), n_slots - 1),
                            least(floor((ends - 1) / block)::bigint + 1, n_slots - 1) + 1)) t(rank)),
cut as (
  select source_id, doc_id, start, epoch, rank, greatest(begins, ceil(rank * block)::bigint) - begins as first_word,
         least(ends, case when rank < n_slots - 1 then ceil((rank + 1) * block)::bigint else words end)
         - greatest(begins, ceil(rank * block)::bigint) as n_words
  from ranked_readings),
pieces as (
  select slot, epoch, rank, source_id, doc_id, start, first_word, n_words
  from cut join slots using (source_id, rank) where n_words > 0),
taken as (select source_id, doc_id, start, sum(n_words)::bigint as taken from pieces group by all)
select p.doc_id, p.size::bigint as size, p.source_size, p.target, coalesce(case when p.size > 0 then t.taken end, 0)::bigint as taken
from placed p left join taken t on p.source_id = t.source_id and p.start = t.start and p.doc_id is not distinct from t.doc_id
"""


@register(OP2_SQL)
def op2_mix_sources(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@register()
def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@register()
def op4_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
with parts as (
  select page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages)),
cut as (select *, string_split(host, '.') as l from parts),
ends as (
  select host, l, array_to_string(l[i :], '.') as tail, array_to_string(l[i + 1 :], '.') as parent, len(l) - i + 1 as length
  from (select distinct host, l from cut), lateral unnest(range(1, len(l) + 1)) u(i)),
hits as (
  select host, length - starts_with(rule, '!')::int + 1000000 * starts_with(rule, '!')::int as weight,
         length - starts_with(rule, '!')::int as taken
  from ends join (select unnest([{suffixes}]) as rule) r on rule = tail or rule = '*.' || parent or rule = '!' || tail),
named as (select host, l, coalesce(arg_max(taken, weight), 1) as taken from ends left join hits using (host) group by host, l),
leveled as (
  select page_id, host, path, array_to_string(l[-taken :], '.') as suffix,
         case when len(l) <= taken then host else array_to_string(l[-(taken + 1) :], '.') end as domain
  from parts join named using (host)),
seen as (select doc_id as page_id, count(*) as n, sum(quality) as good from labels where quality in (0, 1) group by 1),
hosts as (
  select host, domain, suffix, coalesce(sum(n), 0)::double as n, coalesce(sum(good), 0)::double as good
  from leveled left join seen using (page_id) group by all),
domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(good) as good from domains group by all),
root as (select (sum(good) + 0.5::double) / (sum(n) + 1) as rate from suffixes),
s0 as (select suffixes.*, rate as prior from suffixes, root),
ms as (select case when extra > 0 and room > 0 then least(1000.0::double, greatest(1.0::double, round(room / extra - 1, 6))) else 1000.0::double end as strength from (
  select sum(round(n * pow(good / n - prior, 2) - prior * (1 - prior), 9)) as extra, sum(round((n - 1) * prior * (1 - prior), 9)) as room
  from s0 where n > 0 and prior * (1 - prior) > 0)),
s1 as (select *, (good + prior * strength) / (n + strength) as rate from s0, ms),
d0 as (select domains.*, rate as prior from domains join s1 using (suffix)),
md as (select case when extra > 0 and room > 0 then least(1000.0::double, greatest(1.0::double, round(room / extra - 1, 6))) else 1000.0::double end as strength from (
  select sum(round(n * pow(good / n - prior, 2) - prior * (1 - prior), 9)) as extra, sum(round((n - 1) * prior * (1 - prior), 9)) as room
  from d0 where n > 0 and prior * (1 - prior) > 0)),
d1 as (select *, (good + prior * strength) / (n + strength) as rate from d0, md),
h0 as (select hosts.*, rate as prior from hosts join d1 using (domain)),
mh as (select case when extra > 0 and room > 0 then least(1000.0::double, greatest(1.0::double, round(room / extra - 1, 6))) else 1000.0::double end as strength from (
  select sum(round(n * pow(good / n - prior, 2) - prior * (1 - prior), 9)) as extra, sum(round((n - 1) * prior * (1 - prior), 9)) as room
  from h0 where n > 0 and prior * (1 - prior) > 0)),
h1 as (select *, (good + prior * strength) / (n + strength) as rate from h0, mh),
known as (select host, rate, rate - 1.645::double * sqrt(rate * (1 - rate) / (n + strength + 1)) as bound from h1),
judged as (
  select page_id, host, path, rate, bound,
         case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
              when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
              when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
              when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
              when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from leveled join known using (host))
select page_id, host, path, rule,
       case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
            when bound >= 0.75 then 'allow' else 'block' end as verdict,
       round(rate, 9) as rate, round(bound, 9) as bound
from judged
""".replace("{suffixes}", ", ".join(f"'{s}'" for s in urls.SUFFIXES))


@register(OP5_SQL)
def op5_url_filter(spark, sf_dir):
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.col("quality").alias("good")
    )
    found = urls.judge(table(spark, sf_dir, "pages"), outcomes, RULES)
    return found.withColumns({c: F.round(c, 9) for c in ("rate", "bound")})


@register()
def op6_decontaminate(spark, sf_dir):
    return decontaminate.overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@register()
def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP8_SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as w from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.w::double[], c.w::double[])::bigint as score
  from usable q join usable c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 20
"""


@register(OP8_SQL)
def op8_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def _licenses_sql():
    values = ", ".join(
        f"({i}, string_split('{text}', ' '), '{label}', {str(exact).lower()})"
        for i, (text, label, exact) in enumerate(
            [(*p, True) for p in licenses.PHRASES] + [(*n, False) for n in licenses.NOTICES]
        )
    )
    return rf"""
with recursive texts as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
templates as (select * from (values {values}) t(template, w, label, exact)),
sizes as (select *, case when exact or len(w) < 3 then 2 else 3 end as k from templates),
t_grams as (
  select template, label, exact, k, len(w) - k + 1 as n_grams, i as t_place, array_to_string(w[i + 1 : i + k], ' ') as gram
  from sizes, lateral unnest(range(len(w) - k + 1)) u(i)),
places as (select row, w, i as place from texts, lateral unnest(range(len(w))) u(i)),
grams as (
  select row, place, k, array_to_string(w[place + 1 : place + k], ' ') as gram
  from places, (values (2), (3)) s(k) where place + k <= len(w)),
votes as (
  select row, template, label, exact, n_grams, place - t_place as diagonal, t_place, place,
         case when exact then 0 else 3 * floor(round(n_grams * 0.3::double / 2, 6))::int end as drift
  from grams join t_grams using (k, gram)),
near as (
  select s.*, v.t_place, v.place
  from (select distinct row, template, label, exact, n_grams, drift, diagonal from votes) s
  join votes v on v.row = s.row and v.template = s.template and v.diagonal between s.diagonal and s.diagonal + s.drift),
likely as (
  select * from near
  qualify count(distinct t_place) over (partition by row, template, diagonal) / n_grams >= case when exact then 1.0 else 0.7 end),
chains as (
  select row, template, diagonal, place, t_place, 1 as long from likely
  union
  select c.row, c.template, c.diagonal, n.place, n.t_place, long + 1
  from chains c join likely n on n.row = c.row and n.template = c.template and n.diagonal = c.diagonal
    and n.place > c.place and n.t_place > c.t_place),
spans as (
  select row, template, any_value(label) as label, any_value(exact) as exact,
         max(long) / any_value(n_grams) as covered, min(place) as first_word
  from likely join chains using (row, template, diagonal, place, t_place) group by row, template, diagonal),
kept as (select * from spans where covered >= case when exact then 1.0 else 0.7 end)
select doc_id, any_value(len(w))::bigint as n_words, count(*) filter (exact) as n_base,
       min(first_word) filter (exact) as first_word, max(first_word) filter (exact) as last_word,
       coalesce(string_agg(distinct label, ',' order by label) filter (exact), '') as base_labels,
       coalesce(string_agg(distinct label, ',' order by label), '') as labels,
       coalesce(max(covered), 0) as score
from texts left join kept using (row) group by row, doc_id
"""


@register(_licenses_sql())
def op9_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def crawl_records(pages):
    """Crawl records as pages would leave them: a response each, then revisits of two kinds.

    A page's response comes at a time by its number.  The first revisit follows under
    another spelling of the url, with the same tag, or for every fifth page another one; the
    second has no tag and comes, for every third page, before the response.
    """
    base = pages.select(
        "page_id", "url", "html", F.expr("page_id * 7919 % 100003 * 10").alias("t"), F.md5("html").alias("tag")
    )
    day = F.concat(F.lit("day "), F.expr("page_id % 7").cast("string"))
    response = base.select(
        (F.col("page_id") * 3).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        F.col("t").alias("time"),
        F.lit(200).alias("status"),
        F.create_map(
            F.lit("etag"), F.col("tag"), F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"),
            F.lit("date"), F.col("t").cast("string"),
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    none = F.lit(None).cast("string")
    first = base.select(
        (F.col("page_id") * 3 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        F.concat(F.regexp_replace("url", "^https?", "HTTP"), F.lit("#again")).alias("url"),
        (F.col("t") + 5).alias("time"),
        F.lit(304).alias("status"),
        F.create_map(
            F.lit("etag"), F.when(F.expr("page_id % 5 = 0"), F.lit("other")).otherwise(F.concat(F.lit("W/"), F.col("tag"))),
            F.lit("content-type"), F.lit("text/plain"), F.lit("date"), (F.col("t") + 5).cast("string"),
        ).alias("headers"),
        none.alias("payload"),
    )
    second = base.select(
        (F.col("page_id") * 3 + 2).alias("record_id"),
        F.lit("revisit").alias("kind"),
        "url",
        F.expr("if(page_id % 3 = 0, t - 7, t + 100)").alias("time"),
        F.lit(304).alias("status"),
        F.create_map(F.lit("last-modified"), day).alias("headers"),
        none.alias("payload"),
    )
    return response.union(first).union(second)


OP10_SQL = r"""
with base as (
  select page_id, url, html, page_id * 7919 % 100003 * 10 as t, md5(html) as tag, 'day ' || (page_id % 7) as day,
         regexp_replace(trim(url), '#.*$', '') as bare
  from pages),
split as (
  select *, regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from base),
keyed as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
            || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                 lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))), '&'), ''), '') as canonical
  from split),
revisits as (
  select page_id * 3 + 1 as record_id, canonical, t + 5 as time, case when page_id % 5 = 0 then 'other' else tag end as tag,
         null as day from keyed
  union all
  select page_id * 3 + 2, canonical, case when page_id % 3 = 0 then t - 7 else t + 100 end, null, day from keyed),
earlier as (
  select r.record_id, max(struct_pack(t := k.t, v := k.page_id * 3)) as found
  from revisits r join keyed k on r.canonical = k.canonical and k.t < r.time group by 1),
judged as (
  select r.record_id, r.canonical, r.time, e.found.v as before,
         case when e.found is null then 'no_response'
              when r.tag is not null then case when k.tag = r.tag then 'resolved' else 'mismatch' end
              when k.day = r.day then 'resolved' else 'mismatch' end as outcome,
         k.html, k.t, r.tag as own_tag, k.tag, k.day
  from revisits r left join earlier e using (record_id) left join keyed k on k.page_id * 3 = e.found.v)
select record_id, canonical, time, case when outcome = 'resolved' then before end as refers_to, outcome,
       case when outcome = 'resolved' then 200 end as status,
       case when outcome = 'resolved' then html end as payload,
       case when outcome = 'resolved' then
         'content-type=text/html;date=' || case when own_tag is null then t else time end
         || ';etag=' || case when own_tag is null then tag else 'W/' || tag end || ';last-modified=' || day end as headers
from judged
"""


@register(OP10_SQL)
def op10_revisits(spark, sf_dir):
    found = revisits.resolve(crawl_records(table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.map_entries("headers"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.withColumn("headers", text)


@register()
def op11_language_model(spark, sf_dir):
    return language_model.score(table(spark, sf_dir, "documents"))


OP12_SQL = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, r.vec_id, r.label, list_inner_product(a.w, r.w)::bigint as score
  from usable a join usable r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from scored where label = anchor_label)
  where place <= 5),
pairs as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from positives p join scored s using (anchor_id)
  where s.label <> s.anchor_label and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from pairs where rank <= 3
"""


@register(OP12_SQL)
def op12_hard_negatives(spark, sf_dir):
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(rows, rows.where("vec_id % 50 = 0"))


@register()
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register()
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
