"""Thin queries over the operators, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regfeed.llm import curriculum, histogram_pack, huffman_ids, hyperplane_dedup, license_scan, line_rules, nbsvm, norm_topk, overlap_tokens, quote_links, shared_lists, t_occurrence, trie_codes
from regfeed.llm.common import read
from regfeed.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query("op2_overlap_tokens")
def op2(spark, sf_dir):
    return overlap_tokens.token_counts(read(spark, sf_dir, "documents"))


@query("op8_huffman_ids")
def op8(spark, sf_dir):
    return huffman_ids.round_trip(read(spark, sf_dir, "documents"))


@query("op10_histogram_pack")
def op10(spark, sf_dir):
    return histogram_pack.pack_documents(read(spark, sf_dir, "documents"))


# Smallest vertex reachable over ``edges`` (a, b), both directions given.
REACH_SQL = """reach as (
  select a as id, b as other from edges union select r.id, e.b from reach r join edges e on r.other = e.a
), joined as (select id, min(least(id, other)) as component_id from reach group by id)"""


@query(
    "op5_hyperplane_dedup",
    f"""with recursive sound as (
  select vec_id, label, embedding::double[] as v from embeddings where label is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), edges as materialized (
  select a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93
), {REACH_SQL}
select e.vec_id, coalesce(n, 0) as n_links, coalesce(component_id, e.vec_id) as component_id, coalesce(component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join joined on e.vec_id = joined.id left join (select a, count(*) as n from edges group by a) l on e.vec_id = l.a""",
)
def op5(spark, sf_dir):
    return hyperplane_dedup.near_copies(read(spark, sf_dir, "embeddings"))


@query(
    "op9_t_occurrence",
    f"""with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), sets as materialized (
  select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingles from worded
), entries as materialized (select doc_id, len(shingles) as n, hash(unnest(shingles)) as shingle from sets
), pairs as (
  select a.doc_id as x, b.doc_id as y, a.n as m, b.n as n, count(*) as shared from entries a join entries b on a.shingle = b.shingle and a.doc_id < b.doc_id
  group by all having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges as materialized (select x as a, y as b from pairs union all select y, x from pairs
), {REACH_SQL}
select s.doc_id, len(shingles) as n_shingles, coalesce(k, 0) as n_links, coalesce(component_id, s.doc_id) as component_id
from sets s left join joined on s.doc_id = joined.id left join (select a, count(*) as k from edges group by a) l on s.doc_id = l.a""",
)
def op9(spark, sf_dir):
    return t_occurrence.jaccard_groups(read(spark, sf_dir, "documents"), width=4, percent=85)


LINE_SQL = f"""with worded as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from documents
), windows as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as words
  from worded where len(w) > 2
), again as (select doc_id, i from (select *, count(*) over (partition by doc_id, words) as n from windows) where n > 1
), repeated as (select doc_id, count(distinct i + k) as n from again, (values (0), (1), (2)) t(k) group by doc_id
), lines as (
  select doc_id, unnest(string_split(t, chr(10))) as line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as v from worded
), judged as (
  select *, len(v) as n, 100 * (length(line) - length(regexp_replace(line, {_quoted(line_rules.MARKS)}, '', 'g')) - {line_rules.FREE_MARKS})
      > {line_rules.MARKS_PERCENT} * coalesce(list_sum(list_transform(v, lambda x: length(x))), 0)
    or (len(v) >= {line_rules.SENTENCE_WORDS} and not regexp_matches(line, {_quoted(line_rules.CLOSED)}))
    or len(regexp_extract_all(line, {_quoted(line_rules.SEPARATORS)})) >= 2
    or regexp_matches(line, {_quoted(line_rules.MENU)}) or regexp_matches(line, {_quoted(line_rules.BOILERPLATE)}) as failed
  from lines where len(v) > 0
), per_line as (
  select doc_id, count(*) - count(distinct line) as dup, coalesce(sum(n) filter (where failed), 0) as lost, count(*) filter (where failed) as failing from judged group by doc_id
), figures as (
  select doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    length(t) - length(regexp_replace(t, {_quoted(line_rules.SYMBOLS)}, '', 'g')) as n_symbols, coalesce(dup, 0) as n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words, cast(coalesce(lost, 0) as bigint) as lost_words, coalesce(failing, 0) as failed_lines
  from worded left join per_line using (doc_id) left join repeated r using (doc_id)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_words <= {line_rules.LOSS_PERCENT} * n_words as kept
from figures"""


@query("op3_line_rules", LINE_SQL)
def op3(spark, sf_dir):
    docs = line_rules.line_first(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.drop("text")


@query("op7_nbsvm")
def op7(spark, sf_dir):
    return nbsvm.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(
    "op6_curriculum_mix",
    """with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '')) as token
  from documents
), sums as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source
), weighed as (
  select *, [3.0, 1.0, 2.0][1 + place % 3]::double as weight, (source_size * 2)::double as cap from sums
), leveled as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from weighed window before as (order by cap / weight, place rows between unbounded preceding and 1 preceding)
), targets as (
  select *, case when cap <= level * weight then cap
    else (select arg_min(level, cap / weight) from leveled where cap > level * weight) * weight end as target
  from leveled
), stream as (
  select doc_id, size, source_size, target,
    coalesce(sum(size) over (partition by s.source order by token, doc_id, size rows between unbounded preceding and 1 preceding), 0) + size / 2.0::double as middle
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast(case when source_size > 0 then greatest(ceil((target - middle) / source_size), 0) else 0 end as bigint) * size as taken
from stream""",
)
def op6(spark, sf_dir):
    mixed = curriculum.curriculum(read(spark, sf_dir, "documents"))
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(1.0))
    # In training order; documents that are not taken follow.
    digest = mixed.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).cast("long").alias("taken"), first.alias("_first"))
    return digest.orderBy("_first", "doc_id").drop("_first")


@query(
    "op1_quote_links",
    r"""with recursive given as (
  select *, row_number() over () as uid from (select cast(conv_id as bigint) as conv_id, cast(turn as bigint) as turn, role, text from conversations)
), raw as (
  select uid, conv_id, turn, unnest(range(len(parts))) as line, unnest(parts) as raw
  from (select *, string_split(coalesce(text, ''), chr(10)) as parts from given)
), lines as (
  select uid, conv_id, turn, line, regexp_extract(raw, '^[ \t]*(?:>[ \t]?)*') as mark,
    case when regexp_matches(raw, '^[ \t]*>') then length(mark) - length(replace(mark, '>', '')) else 0 end as level,
    case when level > 0 then substr(raw, length(mark) + 1) else raw end as words,
    trim(regexp_replace(lower(words), '\s+', ' ', 'g'), ' ') as norm
  from raw
), marked as (
  select *, case when lag(level) over m = level and lag(norm) over m <> '' then 0 else 1 end as starts,
    coalesce(lead(level) over m, 0) as next_level
  from lines window m as (partition by uid order by line)
), runs as (
  select *, sum(starts) over (partition by uid order by line) as run from marked
), passages as (
  select uid, conv_id, turn, level, string_agg(norm, ' ' order by line) as passage from runs where norm <> '' group by uid, conv_id, turn, level, run
), firsts as (
  select conv_id, passage, min(turn) as original from (
    select conv_id, turn, passage from passages where level = 0 union all select conv_id, turn, norm from lines where level = 0 and norm <> '')
  where conv_id is not null and turn is not null group by conv_id, passage
), linked as (
  select p.*, case when f.original < p.turn then f.original end as original
  from passages p left join firsts f using (conv_id, passage) where p.level > 0
), figures as (
  select uid, count(*) as n_quoted, count(original) as n_linked, max(level) as deepest from linked group by uid
), parents as (
  select conv_id, turn, min(parent) as reply_to from (
    select uid, conv_id, turn, arg_max(original, {'a': -level, 'b': original}) as parent from linked where original is not null group by uid, conv_id, turn)
  group by conv_id, turn
), climbed as (
  select conv_id, turn, reply_to as top, 1 as steps from parents
  union all
  select c.conv_id, c.turn, p.reply_to, c.steps + 1 from climbed c join parents p on c.conv_id = p.conv_id and c.top = p.turn
), chains as (
  select conv_id, turn, arg_max(top, steps) as top, max(steps) as steps from climbed group by conv_id, turn
), bodies as (
  select uid, trim(string_agg(words, chr(10) order by line), ' ' || chr(9) || chr(13) || chr(10)) as body from marked
  where level = 0 and not (next_level > 0 and regexp_matches(words, '(?i)^\s*(on\b.*|.*\S) wrote:\s*$')) group by uid
)
select g.conv_id, g.turn, g.role, md5(coalesce(b.body, '')) as body_md5, coalesce(n_quoted, 0) as n_quoted, coalesce(n_linked, 0) as n_linked,
  coalesce(deepest, 0) as deepest, p.reply_to, coalesce(c.top, g.turn) as thread, coalesce(c.steps, 0) as depth,
  row_number() over (partition by g.conv_id order by coalesce(c.top, g.turn) nulls first, coalesce(c.steps, 0), g.turn nulls first, uid) - 1 as position
from given g left join bodies b using (uid) left join figures f using (uid) left join parents p on g.conv_id = p.conv_id and g.turn = p.turn
  left join chains c on g.conv_id = c.conv_id and g.turn = c.turn""",
)
def op1(spark, sf_dir):
    ordered = quote_links.reply_order(read(spark, sf_dir, "conversations"))
    body = F.md5(F.col("body").cast("binary")).alias("body_md5")
    return ordered.select("conv_id", "turn", "role", body, "n_quoted", "n_linked", "deepest", "reply_to", "thread", "depth", "position")


# Documents as files: source / language / file. One that closes with a licence line stands for the licence file of its folder,
# which is the whole source for English ones.
FILES = """select doc_id, text, case
  when regexp_like(substring_index(trim(trailing '\\n' from text), '\\n', -1), '(?i)licen[cs]ed? ') then concat_ws('/', source, case when lang = 'en' then null else lang end, concat('LICENSE.', doc_id))
  else concat_ws('/', source, lang, concat(doc_id, '.txt')) end as path
from {documents}"""


def licence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES, documents=read(spark, sf_dir, "documents"))


def _licence_sql() -> str:
    """Production weights, headers, full texts, leading comments and SPDX lines. RE2 has no possessive repeats and needs none."""
    scan = license_scan
    plain = lambda pattern: _quoted(pattern.replace("*+", "*").replace("?+", "?"))
    known = [(n, t, 0) for n, t in scan.TEMPLATES] + [(n, t, 1) for n, t in (*scan.HEADERS, *scan.TEXTS)]
    head = r"^\s*(?:#![^\n]*\n\s*)?(?:/\*|<!--|\x22{3}|\x27{3})"
    marks = r"^\s*(?:#|//|--|;|%|\(\*|(?i:rem)\b)"
    file = "string_split(path, '/')[-1]"
    term = f"regexp_extract_all(lower(%s), '{scan.TERM}')"
    named = f"list_transform(flatten(list_transform(regexp_extract_all(text, {_quoted(scan.SPDX)}, 1), lambda x: regexp_extract_all(lower(x), '{scan.IDENTIFIER}'))), lambda x: regexp_replace(x, {_quoted(scan.SUFFIX)}, ''))"
    return f"""with files as materialized (
  select doc_id, coalesce(text, '') as text, case when regexp_matches(string_split(rtrim(text, chr(10)), chr(10))[-1], '(?i)licen[cs]ed? ')
      then concat_ws('/', source, case when lang = 'en' then null else lang end, 'LICENSE.' || doc_id)
    else concat_ws('/', source, lang, doc_id || '.txt') end as path, regexp_replace(path, '/?[^/]*$', '') as directory
  from documents
), templates(licence, text, long) as (values {", ".join(f"({_quoted(n)}, {_quoted(t)}, {k})" for n, t, k in known)}
), shapes as materialized (
  select licence, template, long, term, count(*) as tf from (select licence, md5(licence || ' ' || text) as template, long, unnest({term % "text"}) as term from templates) group by all
), statements as materialized (
  select path, row_number() over () as line, words from (select path, unnest(string_split(text, chr(10))) as words from files)
  where regexp_matches(words, {_quoted(scan.ANCHORS)}) and not regexp_matches(words, {_quoted(scan.SPDX)})
  union all select path, -2, text from files where regexp_matches({file}, {_quoted(scan.LICENCE_FILE)}) and text <> ''
  union all select path, -1, words from (
    select path, case when regexp_matches(text, {_quoted(head)}) then regexp_extract(text, {plain(scan.BLOCK_COMMENT)})
      when regexp_matches(text, {_quoted(marks)}) then array_to_string(rows_[1:coalesce(list_position(list_transform(rows_, lambda x: not regexp_matches(x, {_quoted(scan.LINE_COMMENT)})), true) - 1, len(rows_))], chr(10))
      else '' end as words
    from (select path, text, list_filter(string_split(text, chr(10)), lambda x: not starts_with(x, '#!')) as rows_ from files)) where words <> ''
), tfs as materialized (select path, line, term, count(*) as tf from (select path, line, unnest({term % "words"}) as term from statements) group by all
), found as (select unnest(list_distinct({term % "text"})) as term from files
), idfs as materialized (
  select term, ln((select count(*) + 1.0::double from files) / (count(f.term) + 1.0::double)) + 1.0::double as idf
  from (select term from shapes union select term from tfs) s left join found f using (term) group by term
), weighed as (
  select licence, template, long, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by template)) as template_weight from shapes join idfs using (term)
), vectors as materialized (select path, line, term, tf * idf as weight from tfs join idfs using (term)
), lengths as (select path, line, sqrt(sum(weight * weight)) as norm from vectors group by all
), scores as (
  select path, licence, long, round(sum(weight * template_weight) / any_value(norm), 6) as score
  from vectors join weighed using (term) join lengths using (path, line) where line < 0 or long = 0 group by path, line, licence, template, long
), met as (
  select path, arg_min(licence, {{'l': -long, 'a': -score, 'b': licence}}) as met_licence, arg_min(score, {{'l': -long, 'a': -score, 'b': licence}}) as met_score
  from scores where score >= {scan.LEAST} group by path
), declared as (
  select path, min(name) as declared from (select path, {named} as names from files where regexp_matches(text, {_quoted(scan.SPDX)})) d
  left join (values {", ".join(f"({_quoted(n)})" for n in scan.IDENTIFIERS)}) k(name) on list_contains(d.names, lower(name)) group by path
), own as materialized (
  select path, coalesce(declared, met_licence) as own_licence, case when declared is not null then 1.0::double else met_score end as score from met full join declared using (path)
), speaks as (
  select directory as source_directory, arg_min_null(own_licence, {{'n': own_licence is null, 'a': -score, 'b': path}}) as licence
  from (select distinct path, directory from files) left join own using (path)
  where regexp_matches({file}, {_quoted(scan.LICENCE_FILE)}) and (own_licence is not null or regexp_matches({file}, {_quoted(scan.STATED_FILE)})) group by all
), above as (
  select directory, unnest(range(0, len(parts) + 1)) as depth, array_to_string(parts[1:depth], '/') as source_directory
  from (select distinct directory, string_split(directory, '/') as parts from files)
), heirs as (
  select directory, arg_max_null(licence, depth) as licence, arg_max(source_directory, depth) as source_directory from above join speaks using (source_directory) group by directory
)
select doc_id, f.path, coalesce(own_licence, case when heir then h.licence end) as licence, case when heir then h.source_directory end as inherited_from
from (select doc_id, path, directory, path not in (select path from own) and not regexp_matches({file}, {_quoted(scan.STATED_FILE)}) as free from files) f
left join own using (path) left join heirs h using (directory), lateral (select free and h.licence is not null as heir)"""


LICENCE_SQL = _licence_sql()


@query("op4_license_scan", LICENCE_SQL)
def op4(spark, sf_dir):
    return license_scan.scan(licence_files(spark, sf_dir)).select("doc_id", "path", "licence", "inherited_from")


def _whole_sql(scale: int, *others: str) -> str:
    """Vectors without NULL or non-finite components, as lists of whole numbers in double precision."""
    return f"""select {", ".join(["vec_id", *others])}, list_transform(embedding, lambda x: floor({scale} * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"""


@query(
    "op11_shared_lists",
    f"""with rows_ as materialized (select * replace (case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label) from ({_whole_sql(256, "label")}) where label is not null
), scores as materialized (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from rows_ a join rows_ b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5""",
)
def op11(spark, sf_dir):
    return shared_lists.hard_negatives(read(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    """Rounds of the codebooks, one after the other. ``nearest`` of a round names for each part its entry and squared distance."""
    ctes = [
        f"rows_ as materialized ({_whole_sql(1_024, 'label')})",
        "parts as materialized (select vec_id, p, v[1 + p * len(v) // 4 : (p + 1) * len(v) // 4] as part, list_dot_product(part, part) as own from rows_, range(4) t(p))",
        "book0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, part as entry, own as size from parts qualify e < 256)",
    ]
    for k in range(trie_codes.ROUNDS + 1):
        ctes.append(f"""nearest{k} as materialized (select vec_id, p, arg_min(e, (d, e)) as e, min(d) as d from (
    select vec_id, p, e, own - 2 * list_dot_product(part, entry) + size as d from parts join book{k} using (p)) group by vec_id, p)""")
        if k < trie_codes.ROUNDS:
            ctes.append(f"""means{k} as (select p, e, list(m order by i) as mean from (
    select p, e, i, floor(sum(part[i]) / count(*)) as m from parts join nearest{k} using (vec_id, p), range(1, 1 + (select max(len(part)) from parts)) t(i) group by p, e, i) group by p, e)""")
            ctes.append(f"""book{k + 1} as materialized (select p, e, coalesce(mean, entry) as entry, list_dot_product(coalesce(mean, entry), coalesce(mean, entry)) as size
    from book{k} left join means{k} using (p, e))""")
    last = trie_codes.ROUNDS
    return f"""with {", ".join(ctes)}, digest as (
  select coalesce(sha256(string_agg(list_aggregate(list_transform(entry, lambda x: cast(cast(x as bigint) as varchar)), 'string_agg', ','), ',' order by p, e)), '') as codebooks_sha256 from book{last}
), coded as (
  select vec_id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from nearest{last} group by vec_id
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join rows_ using (vec_id), digest"""


@query("op12_trie_codes", _codes_sql())
def op12(spark, sf_dir):
    codes, books = trie_codes.compress(read(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(trie_codes.digest(books)))


@query(
    "op13_norm_topk",
    f"""with rows_ as materialized ({_whole_sql(64)})
select q.vec_id as query_id, cast(row_number() over (partition by q.vec_id order by list_dot_product(q.v, x.v) desc, x.vec_id) as integer) as rank,
  x.vec_id, cast(list_dot_product(q.v, x.v) as bigint) as score
from rows_ q join rows_ x on q.vec_id % 20 = 0 and q.vec_id <> x.vec_id qualify rank <= 20""",
)
def op13(spark, sf_dir):
    return norm_topk.top_inner_products(read(spark, sf_dir, "embeddings"))
