"""Queries of the training-data operators by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import bare
from graphloom.llm import canonical_text, dedupe, mixing, value_map
from graphloom.llm.bpe import encode_corpus
from graphloom.llm.quality import NO_SYMBOL, STOP_END, WORD_RUN, _words, text_counts, text_quality
from graphloom.operators.orphans import triple_field
from graphloom.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), keep=["doc_id"])


TRIPLE_RAW = ["head_id", "relation", "tail_id", "tail_literal", "raw_record"]


def _triple_form() -> dict:
    return {"head_key": bare(triple_field("head_id")), "relation_key": bare(triple_field("relation")), "tail_key": bare(triple_field("tail_id")), "literal_key": triple_field("tail_literal")}


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "triples").select("upstream_index", *TRIPLE_RAW)
    return dedupe.copies(rows, TRIPLE_RAW, _triple_form(), "upstream_index")


@query
def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record in canonical form, with the number of its copies."""
    rows = table(spark, sf_dir, "triples").select("upstream_index", *TRIPLE_RAW)
    return dedupe.canonical_groups(dedupe.raw_groups(rows, TRIPLE_RAW, "upstream_index"), _triple_form())


_TRIPLE_SQL = """WITH f AS (
  SELECT upstream_index,
    CASE WHEN raw_record IS NULL THEN head_id ELSE coalesce(raw_record->>'$.h', raw_record->>'$.head') END AS h,
    CASE WHEN raw_record IS NULL THEN relation ELSE coalesce(raw_record->>'$.r', raw_record->>'$.relation') END AS r,
    CASE WHEN raw_record IS NULL THEN tail_id ELSE coalesce(raw_record->>'$.t', raw_record->>'$.tail') END AS t,
    CASE WHEN raw_record IS NULL THEN tail_literal ELSE raw_record->>'$.tail_literal' END AS literal_key
  FROM triples
), k AS (
  SELECT upstream_index, literal_key,
    regexp_replace(lower(h), '[^\\p{L}\\p{N}]', '', 'g') AS head_key,
    regexp_replace(lower(r), '[^\\p{L}\\p{N}]', '', 'g') AS relation_key,
    regexp_replace(lower(t), '[^\\p{L}\\p{N}]', '', 'g') AS tail_key
  FROM f
) """
SQL["p5_found"] = _TRIPLE_SQL + """SELECT keep_index, upstream_index AS copy_index FROM (
  SELECT upstream_index, min(upstream_index) OVER (PARTITION BY head_key, relation_key, tail_key, literal_key) AS keep_index FROM k
) WHERE upstream_index > keep_index"""
SQL["p5_records"] = _TRIPLE_SQL + """, s AS (
  SELECT k.*, t.head_id, t.relation, t.tail_id, t.tail_literal, t.raw_record FROM k JOIN triples t USING (upstream_index)
) SELECT head_key, relation_key, tail_key, literal_key, min(upstream_index) AS keep_index, count(*) AS n_copies,
  count(DISTINCT {'a': head_id, 'b': relation, 'c': tail_id, 'd': tail_literal, 'e': raw_record}) AS n_spellings
FROM s GROUP BY ALL"""


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), keep=["doc_id"]).where("kind <> 'prose'").select("doc_id", "kind")


@query
def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts of every text as it stands."""
    return text_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])


_STOP_SQL = STOP_END.replace("'", "''")
SQL["p8_counts"] = f"""WITH w AS (
  SELECT doc_id, text, regexp_extract_all(text, '{WORD_RUN}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\p{{Z}}\\p{{C}}]')) AS lines, length(regexp_replace(text, '{NO_SYMBOL}', '', 'g')) AS symbols FROM documents
), c AS (
  SELECT *, len(words) AS n, len(lines) AS m, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS letters, len(list_filter(words, lambda x: lower(x) IN ({", ".join("'" + w.replace("'", "''") + "'" for w in sorted(_words()[0]))}))) AS common,
    len(list_filter(lines, lambda x: regexp_matches(x, '{_STOP_SQL}'))) AS stops FROM w
)
SELECT doc_id, CAST(n AS INT) AS n_words, CAST(m AS INT) AS n_lines, round(CASE WHEN n > 0 THEN letters / n END, 6) AS mean_word_length, round(CASE WHEN symbols + letters > 0 THEN symbols / (symbols + letters) END, 6) AS symbol_ratio,
  round(CASE WHEN m > 0 THEN stops / m END, 6) AS stop_line_share, round(CASE WHEN n > 0 THEN common / n END, 6) AS common_word_share FROM c""".replace("\\\\p", "\\p")


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names of every candidate, re-delivered rows once."""
    sides = F.array(*[F.struct(F.lit(s).alias("surface_side"), F.col(f"{s}_surface").alias("surface")) for s in ("head", "tail")])
    rows = table(spark, sf_dir, "candidates").select("candidate_id", "head_surface", "tail_surface").distinct()
    return rows.select("candidate_id", F.explode(sides).alias("s")).select("candidate_id", "s.*")


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _surfaces(spark, sf_dir)
    return rows, value_map.map_values(rows, "surface", table(spark, sf_dir, "core_entities"), "entity_id", "canonical_name", "aliases")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mapped = _mapped(spark, sf_dir)
    return rows.join(mapped, "surface").select("candidate_id", "surface_side", F.coalesce("entry", F.lit("")).alias("entity_id"))


@query
def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces that name no entry, with the number of candidates' sides that hold each."""
    rows, mapped = _mapped(spark, sf_dir)
    counts = rows.where("surface is not null").groupBy("surface").agg(F.count(F.lit(1)).alias("n_rows"))
    known = mapped.where("entry is not null").select("surface")
    return counts.where(F.col("surface").rlike(r"(?U)\S")).join(known, "surface", "left_anti")


def _sql_words(x: str) -> str:
    fold = "translate(lower({}), '{}', '{}')".format(x, *value_map._accents())
    plain = f"regexp_replace(regexp_replace({fold}, '[\\p{{M}}\\p{{Cf}}]', '', 'g'), '\\([^()]*\\)[^\\p{{L}}\\p{{N}}]*$', '')".replace("\\\\", "\\")
    words = f"list_filter(string_split(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')".replace("\\\\", "\\")
    told = f"list_filter({words}, lambda w: w NOT IN ({', '.join(map(repr, value_map.FILLERS))}))"
    return f"CASE WHEN len({told}) > 0 THEN {told} ELSE {words} END"


#: Every typed word is compared with every anchor, and every pair is verified: no segments.
_P4_SQL = f"""WITH sides AS (
  SELECT DISTINCT candidate_id, 'head' AS surface_side, head_surface AS surface FROM candidates UNION SELECT candidate_id, 'tail', tail_surface FROM candidates
), rows AS (SELECT * FROM sides WHERE regexp_matches(surface, '[^\\s\\p{{Z}}\\x1c-\\x1f\\x85]')
), typed AS (SELECT DISTINCT surface, {_sql_words("surface")} AS words FROM rows
), listed AS (SELECT DISTINCT entry, {_sql_words("n")} AS words FROM (SELECT entity_id AS entry, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS n FROM core_entities) WHERE n IS NOT NULL
), names AS (SELECT *, row_number() OVER () AS no FROM listed WHERE len(words) > 0
), each AS (SELECT no, entry, words, word, list_sort(list_filter(list_distinct(words), lambda w: w <> word)) AS rest FROM (SELECT no, entry, words, unnest(list_distinct(words)) AS word FROM names)
), used AS (SELECT word, count(DISTINCT entry) AS n FROM each GROUP BY 1
), seen AS (SELECT DISTINCT a.word FROM each a JOIN each b ON a.entry = b.entry AND a.rest = b.rest AND length(a.word) > 1 AND length(b.word) = 1 AND a.word[1] = b.word
), told AS (SELECT each.*, n, length(word) > 1 AND coalesce(n <= (SELECT max(n) FROM used JOIN seen USING (word)), false) AS cut FROM each JOIN used USING (word)
), least AS (SELECT no, any_value(entry) AS entry, min(n) AS low, bool_and(length(word) = 1) AS letters, list(word) AS all_words, list(word) FILTER (WHERE cut) AS cuts FROM told GROUP BY no
), ref AS (SELECT least.*, word AS anchor FROM least JOIN told USING (no) WHERE n <= greatest(low, (SELECT sqrt(count(DISTINCT entry)) FROM names)) AND (length(word) > 1 OR letters)
), near AS (
  SELECT word, anchor, levenshtein(word, anchor) AS e FROM (SELECT DISTINCT unnest(words) AS word FROM typed) CROSS JOIN (SELECT DISTINCT anchor FROM ref) WHERE levenshtein(word, anchor) <= length(anchor) // 4
), pairs AS (
  SELECT row_number() OVER () AS pair, surface, entry, e, list_distinct(list_filter(words, lambda w: w <> word)) AS mine, list_filter(all_words, lambda w: w <> ref.anchor) AS others, coalesce(cuts, []) AS cuts
  FROM (SELECT surface, words, unnest(list_distinct(words)) AS word FROM typed) JOIN near USING (word) JOIN ref ON ref.anchor = near.anchor
), kept AS (SELECT * FROM pairs WHERE len(mine) > 0 OR len(others) = 0
), costs AS (
  SELECT pair, m, min(CASE WHEN length(m) < length(o) AND regexp_matches(o, '^' || array_to_string(string_split(m, ''), '.*')) AND (length(m) > 1 OR list_contains(cuts, o)) THEN 0 WHEN levenshtein(m, o) <= length(o) // 4 THEN levenshtein(m, o) END) AS c
  FROM (SELECT pair, cuts, m, unnest(others) AS o FROM (SELECT pair, cuts, others, unnest(mine) AS m FROM kept)) GROUP BY 1, 2
), sums AS (SELECT pair, sum(c) AS s, count(c) AS n FROM costs GROUP BY 1
), good AS (
  SELECT surface, entry, min({{'e': e + coalesce(s, 0), 'm': greatest(0, len(others) - len(mine))}}) AS cost FROM kept LEFT JOIN sums USING (pair) WHERE coalesce(n, 0) = len(mine) GROUP BY 1, 2
), best AS (SELECT surface, entry FROM good QUALIFY cost = min(cost) OVER (PARTITION BY surface) AND count(*) OVER (PARTITION BY surface, cost) = 1
) """
SQL["p4_found"] = _P4_SQL + "SELECT candidate_id, surface_side, coalesce(entry, '') AS entity_id FROM rows LEFT JOIN best USING (surface)"
SQL["p4_unmatched"] = _P4_SQL + "SELECT surface, count(*) AS n_rows FROM rows WHERE surface NOT IN (SELECT surface FROM best) GROUP BY 1"


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = table(spark, sf_dir, "candidates").select(F.lit("candidate").alias("quote_kind"), F.col("candidate_id").alias("owner_key"), F.lit(0).alias("quote_pos"), F.col("passage_id").alias("unit_key"), "quote")
    theirs = table(spark, sf_dir, "triples").select("triple_id", F.posexplode("sources").alias("quote_pos", "s"))
    theirs = theirs.select(F.lit("triple").alias("quote_kind"), F.col("triple_id").alias("owner_key"), "quote_pos", F.col("s.source_id").alias("unit_key"), F.col("s.quote").alias("quote"))
    return mine.unionByName(theirs)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "text_units")
    by_passage = units.select(F.lit("candidate").alias("quote_kind"), F.col("passage_id").alias("unit_key"), "raw_text")
    by_source = units.select(F.lit("triple").alias("quote_kind"), F.concat_ws(":", "data_version", "question_id", "doc_index", "sent_index").alias("unit_key"), "raw_text")
    return by_passage.unionByName(by_source)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.hidden_quotes(_quotes(spark, sf_dir), _units(spark, sf_dir))


@query
def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct quote and unit text in the one form in which what looks the same is the same."""
    texts = _quotes(spark, sf_dir).select("quote").unionAll(_units(spark, sf_dir).select("raw_text"))
    return canonical_text.canonical_texts(texts.where("quote is not null"), "quote")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = written(encode_corpus(table(spark, sf_dir, "documents"), keep=["doc_id", "source"], count_only=True), "sizes")
    return mixing.mix(sizes, table(spark, sf_dir, "mix_targets"))


@query
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mix and how often each is used."""
    return _mix(spark, sf_dir)[0]


@query
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, sf_dir)[1]


@query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source reached its share of the targets that can be met, as near as its largest document allows, within its cap."""
    report = _mix(spark, sf_dir)[1]
    most = table(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.octet_length("text")).alias("largest"))
    rows = report.join(most, "source", "left")
    live = F.sum(F.when(F.col("goal_tokens") > 0, F.col("target_share"))).over(Window.partitionBy())
    met = F.abs(F.col("used_tokens") - F.col("goal_tokens")) <= F.coalesce("largest", F.lit(0)) / 2 + 1
    share = F.when(F.col("goal_tokens") > 0, F.col("target_share") / live).otherwise(0.0)
    return rows.select("source", F.round(share, 6).alias("share_asked"), met.alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"))


SQL["p7_shares"] = """WITH t AS (SELECT DISTINCT source, target_share, max_repeats FROM mix_targets), l AS (
  SELECT t.*, target_share > 0 AND max_repeats >= 1 AND source IN (SELECT source FROM documents WHERE text <> '' AND source IS NOT NULL) AS live FROM t)
SELECT source, round(CASE WHEN live THEN target_share / sum(target_share) FILTER (WHERE live) OVER () ELSE 0 END, 6) AS share_asked, true AS met, true AS within_cap FROM l"""


def _sql_looks(x: str) -> str:
    """SQL for the looks of a text, by the same tables of characters."""
    fold = {chr(n): b for n, b in canonical_text._FOLD.items()}
    one = {a: canonical_text.LOOK_ALIKES.get(b, b) for a, b in fold.items() if len(b) == 1} | canonical_text.LOOK_ALIKES
    for n in [*range(0x370, 0x590), *range(0x1F00, 0x2000)]:
        looks = canonical_text.skeleton(chr(n))
        if looks != chr(n) and len(looks) == 1 and chr(n) not in fold:
            one[chr(n)] = looks
    drop = "".join(a for a, b in fold.items() if not b)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for a, b in fold.items():
        x = f"replace({x}, '{a}', '{b}')" if len(b) > 1 else x
    return f"nfc_normalize(translate({x}, {quoted(''.join(one) + drop)}, {quoted(''.join(one.values()))}))"


SQL["p2_found"] = f"""WITH t AS (SELECT triple_id, unnest(sources) AS s, generate_subscripts(sources, 1) - 1 AS p FROM triples
), q AS (
  SELECT DISTINCT 'candidate' AS quote_kind, candidate_id AS owner_key, 0 AS quote_pos, passage_id AS unit_key, quote FROM candidates WHERE quote <> ''
  UNION SELECT 'triple', triple_id, CAST(p AS INT), s.source_id, s.quote FROM t WHERE s.quote <> ''
), u AS (
  SELECT DISTINCT 'candidate' AS quote_kind, passage_id AS unit_key, raw_text FROM text_units
  UNION SELECT 'triple', data_version || ':' || question_id || ':' || doc_index || ':' || sent_index, raw_text FROM text_units
), x AS (
  SELECT quote_kind, owner_key, quote_pos, bool_or(contains(raw_text, quote)) AS held, bool_or({_sql_looks("quote")} <> '' AND contains({_sql_looks("raw_text")}, {_sql_looks("quote")})) AS seen
  FROM q JOIN u USING (quote_kind, unit_key) GROUP BY 1, 2, 3
)
SELECT quote_kind, owner_key, quote_pos FROM x WHERE seen AND NOT held"""


def _sql_table_form(looks: str) -> str:
    """The table's form of looks without accents on shared letters."""
    to = {chr(n): c for n, c in canonical_text._TO_CYRILLIC.items()}
    latin = "".join(c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in to)
    return f"CASE WHEN regexp_matches({looks}, '[Ѐ-ԯ]') AND NOT regexp_matches(strip_accents({looks}), '[{latin}]') THEN nfc_normalize(translate({looks}, '{''.join(to)}', '{''.join(to.values())}')) ELSE {looks} END"


_RUNS = canonical_text.LETTERS.replace("{Is", "{")
_FOLDED = "".join(chr(n) for n in canonical_text._FOLD).replace("'", "''")
_SCRIPTS = " + ".join(f"CAST(regexp_matches(token, '\\p{{{a}}}') AS INT)" for a in (*canonical_text.ALPHABETS, "Han"))
SQL["p2_forms"] = f"""WITH t AS (SELECT unnest(sources) AS s FROM triples
), c AS (SELECT quote AS text FROM candidates UNION ALL SELECT s.quote FROM t UNION ALL SELECT raw_text FROM text_units UNION ALL SELECT raw_text FROM text_units
), tok AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s)[{_RUNS}]+|[^{_RUNS}]+')) AS token FROM c WHERE text IS NOT NULL) GROUP BY 1
), k AS (SELECT token, n, {_sql_looks("token")} AS looks, translate(token, '{_FOLDED}', '') = token AND nfc_normalize(token) = token AND {_SCRIPTS} < 2 AS clean FROM tok
), best AS (SELECT looks, arg_min(token, {{'n': -n, 't': token}}) AS spelled FROM k WHERE clean GROUP BY 1
), f AS (SELECT token, coalesce(spelled, {_sql_table_form("looks")}) AS form FROM k LEFT JOIN best USING (looks)
), d AS (SELECT DISTINCT text, regexp_extract_all(text, '(?s)[{_RUNS}]+|[^{_RUNS}]+') AS parts FROM c WHERE text IS NOT NULL
), e AS (SELECT text, unnest(parts) AS token, generate_subscripts(parts, 1) AS p FROM d)
SELECT d.text, coalesce(g.form, '') AS form FROM d LEFT JOIN (SELECT text, string_agg(form, '' ORDER BY p) AS form FROM e JOIN f USING (token) GROUP BY 1) g USING (text)"""
