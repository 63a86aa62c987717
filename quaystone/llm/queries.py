"""The thin ``opN_<name>`` queries, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate as _dec
from . import fingerprint as _print
from . import lm as _lm
from . import mainhtml as _html
from . import manifest as _merkle
from . import neardup as _near
from . import periodic as _runs
from . import pieces as _pieces
from . import pii as _pii
from . import simhash as _sim
from . import tokencount as _count
from . import toxicity as _tox
from . import warc as _warc
from .shared import crc, table

QUERIES = {}
ORACLES = {}


def query(name):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@query("op1_decontamination")
def op1(spark, sf_dir):
    return _dec.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_minhash_neardup")
def op7(spark, sf_dir):
    return _near.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query("op4_piecewise_fingerprint")
def op4(spark, sf_dir):
    return _print.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = (crc(F.col("doc_id")) % 4 == 2) & F.col("doc_id").isNotNull()
    machine = _tox.learn(docs, table(spark, sf_dir, "labels"), may_learn=~held_out)
    return _tox.score(docs.select("doc_id", held_out.alias("held_out"), "text"), machine, ["doc_id", "held_out"])


@query("op8_sentencepiece")
def op8(spark, sf_dir):
    return _pieces.encode(table(spark, sf_dir, "documents"), ["doc_id"], digests=True)


@query("op10_token_counts")
def op10(spark, sf_dir):
    return _count.count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op5_lm_scores")
def op5(spark, sf_dir):
    held_out = (crc(F.col("doc_id")) % 7 == 2) & F.col("doc_id").isNotNull()
    return _lm.score_texts(table(spark, sf_dir, "documents"), held_out, ~held_out & F.col("doc_id").isNotNull())


@query("op6_pii")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _pii.digests(_pii.find(docs, _pii.train(docs), ["doc_id"]), ["doc_id"])


@query("op2_warc_index")
def op2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return _warc.look_up_all(pages, *_warc.archive(spark, pages))


@query("op3_html_main_text")
def op3(spark, sf_dir):
    return _html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query("op11_simhash_neardup")
def op11(spark, sf_dir):
    return _sim.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    number = F.when(F.col("doc_id").isNotNull(), crc(F.col("doc_id")))
    return _runs.digests(_runs.find_runs(docs.select("doc_id", _runs.with_repeats(F.col("text"), number).alias("text")), ["doc_id"]), ["doc_id"])


@query("op13_merkle_manifest")
def op13(spark, sf_dir):
    tampered = F.when(crc(F.col("doc_id")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = _merkle.manifest(table(spark, sf_dir, "documents"), altered={"n_chars": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", _merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


ORACLES["op1_decontamination"] = """
with words as (
  select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark where item_id is not null),
item_windows as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') as s
  from item_words, unnest(range(1, greatest(1, len(w) - 12) + 1)) as t(k) where len(w) > 0),
sizes as (select distinct n from item_windows),
doc_windows as (
  select r, k, sizes.n, array_to_string(w[k : k + sizes.n - 1], ' ') as s
  from words, sizes, unnest(range(1, len(w) - sizes.n + 2)) as t(k) where len(w) >= sizes.n),
hits as (select d.r, d.k, d.n, i.item_id from doc_windows d join item_windows i on d.n = i.n and d.s = i.s),
hit_words as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from hits) group by r),
hit_items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, cast(item_id as varchar) as item from hits) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit_words using (r) left join hit_items using (r)
"""

ORACLES["op2_warc_index"] = """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as d, octet_length(encode(coalesce(html, ''))) as n from pages),
g as (select *, case when n >= 100 then min(page_id) over (partition by d) end as head from p)
select page_id, n as payload_bytes, d as payload_digest,
  case when head is null or page_id = head then 'response' else 'revisit' end as record_type,
  case when head is null or page_id = head then null else head end as refers_to
from g
"""

ORACLES["op7_minhash_neardup"] = """
with recursive words as (
  select doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 1 then (case when w[1] = '' then [] else [w[1]] end)
    else list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) end as s from words),
rows_ as (select doc_id, len(s) as n, unnest(s) as x from sets),
pairs as (
  select a.doc_id as i, b.doc_id as j from rows_ a join rows_ b on a.x = b.x and a.doc_id < b.doc_id and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges as (select i, j from pairs union all select j, i from pairs),
reach(i, j) as (select i, j from edges union select r.i, e.j from reach r join edges e on r.j = e.i),
low as (select i, min(j) as m from reach group by i)
select s.doc_id, len(s.s) as n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) as component_id, s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) as kept
from sets s left join low on low.i = s.doc_id
"""

# crc32 of a decimal id, a bit at a time.
CRC_SQL = """
crc_bits(doc_id, digits, done, c) as (
  select distinct doc_id, cast(doc_id as varchar), 0, 4294967295::bigint from documents where doc_id is not null
  union all
  select doc_id, digits, done + 1, xor(v >> 1, (v & 1) * 3988292384)
  from (select *, case when done % 8 = 0 then xor(c, ascii(digits[done // 8 + 1])::bigint) else c end as v from crc_bits where done < 8 * len(digits))),
crcs as (select doc_id, xor(c, 4294967295::bigint) as h from crc_bits where done = 8 * len(digits))"""

# Equal factors of six words q apart follow each other exactly where a run of period q is; shorter runs don't count.
ORACLES["op12_periodic_runs"] = f"""
with recursive {CRC_SQL},
given as (
  select row_number() over () as r, doc_id, coalesce(h, 1) as h, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents left join crcs using (doc_id)),
sized as (select *, len(w) as n, h // 10 as g, case when len(w) > 0 then (h // 10) % len(w) end as a from given),
texts as (
  select r, doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] end) else w end as w
  from sized),
grams as (select r, i, array_to_string(w[i + 1 : i + 6], ' ') as s from texts, unnest(range(0, n - 5)) as t(i) where n >= 6),
same as (select x.r, x.i, y.i - x.i as q from grams x join grams y on x.r = y.r and x.s = y.s and x.i < y.i),
stretches as (select r, q, min(i) as start, max(i) - min(i) + 6 + q as length from (select *, i - row_number() over (partition by r, q order by i) as stretch from same) group by r, q, stretch),
runs as (select r, start, length, min(q) as period from stretches where length >= greatest(12, 2 * q) group by r, start, length),
lines as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as s from runs group by r),
best as (select * from runs qualify row_number() over (partition by r order by length desc, start, period) = 1),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
held as (
  select r, string_agg(word, ' ' order by i) as s
  from (select r, unnest(range(n)) as i, unnest(w) as word from texts) x where not exists (select 1 from gone g where g.r = x.r and g.i = x.i) group by r)
select doc_id, n as n_words, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
  sha256(coalesce(lines.s, '')) as runs_sha256, sha256(coalesce(held.s, '')) as collapsed_sha256
from texts left join lines using (r) left join best using (r) left join held using (r)
"""

_FIELDS = "case when {0} is null then '-' else octet_length(encode(cast({0} as varchar))) || ':' || {0} end"
_LEAF = "sha256(" + " || ".join(_FIELDS.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_LEVEL = "list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"
_BEFORE, _AFTER = "case when k % 2 = 1 then l[k] else '' end", "case when k % 2 = 0 then coalesce(l[k + 2], '') else '' end"
_STEP = f"k // 2, sha256({_BEFORE} || acc || {_AFTER}), proof || {_BEFORE} || {_AFTER}"
ORACLES["op13_merkle_manifest"] = f"""
with recursive {CRC_SQL},
leaves as (
  select doc_id, lang, {_LEAF} as leaf, {_LEAF.replace("n_chars", "shown")} as presented
  from (select documents.*, n_chars + case when h % 7 = 0 then 1 else 0 end as shown from documents left join crcs using (doc_id))),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as k from leaves),
trees(lang, level, l) as (
  select lang, 0, list(leaf order by k) from placed group by lang
  union all select lang, level + 1, {_LEVEL} from trees where len(l) > 1),
subroots as (select lang, l[1] as subroot, row_number() over (order by lang nulls first) - 1 as k from trees where len(l) = 1),
top(level, l) as (
  select 0, list(subroot order by k) from subroots
  union all select level + 1, {_LEVEL} from top where len(l) > 1),
own(doc_id, lang, leaf, level, k, acc, proof) as (
  select doc_id, lang, leaf, 0, k, presented, '' from placed
  union all
  select doc_id, own.lang, leaf, level + 1, {_STEP} from own join trees using (level) where len(l) > 1 and own.lang is not distinct from trees.lang),
whole(doc_id, leaf, subroot, level, k, acc, proof) as (
  select doc_id, leaf, subroot, 0, s.k, acc, proof
  from own join trees using (level) join subroots s on s.lang is not distinct from own.lang where own.lang is not distinct from trees.lang and len(l) = 1
  union all
  select doc_id, leaf, subroot, level + 1, {_STEP} from whole join top using (level) where len(l) > 1)
select doc_id, leaf, subroot, l[1] as root, sha256(proof) as proof_sha256, acc as folded_root, acc = l[1] as verified
from whole join top using (level) where len(l) = 1
"""
