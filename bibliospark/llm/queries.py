"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliospark.llm import conversations, decontaminate, jaccard, language, language_id, mixing, quality, rules, runs, secret_scan, substrings, tokens, toxicity
from bibliospark.llm.common import fold
from bibliospark.session import table, work_folder

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


SQL_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
WHITE_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

RULES_SQL = rf"""
WITH d AS (SELECT doc_id, text AS raw, coalesce(concat('=', source), '') AS host, coalesce(text, '') AS text, {SQL_WORDS.format("coalesce(text, '')")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {WHITE_SQL}) <> '') AS l FROM documents),
g AS (SELECT doc_id, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS tri FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c > 1) GROUP BY 1),
x AS (SELECT doc_id, host, raw, len({SQL_WORDS.format('line')}) AS n, regexp_replace(regexp_replace(lower(trim(line, {WHITE_SQL})), '\d', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS line
  FROM (SELECT doc_id, host, raw, unnest(l) AS line FROM d)),
h AS (SELECT host, count(DISTINCT raw) AS docs FROM d GROUP BY 1),
f AS (SELECT q.host, line FROM (SELECT host, line, count(DISTINCT raw) AS held FROM x GROUP BY 1, 2) q JOIN h ON h.host = q.host WHERE held > 20 AND held > docs * 0.02),
o AS (SELECT doc_id, sum(n) AS n FROM x JOIN f ON f.host = x.host AND f.line = x.line GROUP BY 1),
b AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(o.n, 0) AS lost FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - lost >= n_words * 0.3 AS kept FROM b"""

NORMAL_SQL = r"list_filter(list_transform({}, lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')), lambda x: x <> '')".format(
    SQL_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))

CONTAINED_SQL = f"""
WITH i AS (SELECT item_id, w, least(5, len(w)) AS n FROM (SELECT item_id, {NORMAL_SQL} AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT item_id, n, unnest(list_distinct(list_transform(range(len(w) - n + 1), lambda k: array_to_string(w[k + 1 : k + n], ' ')))) AS sh FROM i),
c AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY 1),
d AS (SELECT doc_id, w, n FROM (SELECT doc_id, {NORMAL_SQL} AS w FROM documents), (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
t AS (SELECT doc_id, n, unnest(list_distinct(list_transform(range(len(w) - n + 1), lambda k: array_to_string(w[k + 1 : k + n], ' ')))) AS sh FROM d),
j AS (SELECT doc_id, item_id, count(*) AS n_common FROM s JOIN t USING (n, sh) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_common, n_common / n_item AS containment FROM j JOIN c USING (item_id) WHERE 10 * n_common >= 8 * n_item"""


REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
o AS (SELECT win, min(doc_id) AS own FROM g GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN o USING (win) WHERE own < doc_id),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = u.doc_id AND c.p = u.p) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

LINKS_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SQL_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(len(w) - least(3, len(w)) + 1), lambda k: array_to_string(w[k + 1 : k + least(3, len(w))], ' '))) AS l FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, len(l) AS n FROM s), e AS (SELECT doc_id, unnest(l) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY 1"""


#: One row: the 256 remainders of the CRC-32 polynomial, from its bits.
CRC_TABLE_SQL = "(SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crc)"


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII string, beside a row of CRC_TABLE_SQL."""
    return f"xor(4294967295, list_reduce(list_transform(range(1, length({text}) + 1), lambda k: CAST(ascii(({text})[k]) AS BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295))"


RUNS_SQL = f"""
WITH h AS (SELECT doc_id, {crc_sql("CAST(doc_id AS VARCHAR)")} AS h, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents, {CRC_TABLE_SQL}),
a AS (SELECT *, len(w) AS n, (h // 10) % 8 AS r, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + r)) END]) ELSE w END AS w FROM a),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 5, 0))) AS i FROM d)),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS start, max(i) + 6 - min(i) AS same FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, same + q AS length, min(q) AS period FROM s WHERE same >= greatest(12 - q, q) GROUP BY 1, 2, 3),
b AS (SELECT doc_id, count(*) AS n_runs, max(struct_pack(l := length, s := -start, p := -period)) AS best,
  sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
u AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN c USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.l AS length, -best.p AS period, 1000 * best.l // -best.p AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""

#: States: 1 nothing yet, 2 after s, 3 after u, 4 after a. The fold runs over the rows of a conversation from its end and
#: keeps, for each state, the least (cost, audit, repaired lines) to the end; inserts are relaxed twice at each place.
REPAIR_SQL = f"""
WITH o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc_of AS k FROM (SELECT *, {crc_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS crc_of FROM conversations, {CRC_TABLE_SQL})),
m AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(sha256(role), text)), copy) AS i, rtrim(text, {WHITE_SQL}) AS shown, left(role, 1) AS r FROM m),
f AS (SELECT *, CASE WHEN shown = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  concat(lag(r) OVER (PARTITION BY conv_id ORDER BY i), r) NOT IN ('su', 'ua', 'au') AND i > 1 AS wrong FROM n),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (wrong) AS illegal, list(struct_pack(r := r, role := role, text := text, fault := fault) ORDER BY i DESC) AS l FROM f GROUP BY 1),
q AS (SELECT *, list_reduce(list_transform(l, lambda e: [struct_pack(c := CAST(e.fault AS BIGINT), a := e.r, x := e.role, t := e.text)]), lambda v, e: {{step}},
  [struct_pack(c := CAST(0 AS BIGINT), a := '', x := '', t := ''), struct_pack(c := CAST(4 AS BIGINT), a := 'II', x := chr(10) || 'user:' || chr(10) || 'assistant:', t := ''),
   struct_pack(c := CAST(2 AS BIGINT), a := 'I', x := chr(10) || 'assistant:', t := ''), struct_pack(c := CAST(0 AS BIGINT), a := '', x := '', t := '')])[1] AS best FROM c)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.x[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN q ON d.conv_id IS NOT DISTINCT FROM q.conv_id"""


def _fold_sql() -> str:
    """One step of REPAIR_SQL: the least ways from each state before a row (e[1]), given those after it (v)."""
    way = lambda cost, letter, to, line="''": f"struct_pack(c := v[{to}].c + {cost}, a := '{letter}' || v[{to}].a, x := {line} || v[{to}].x, t := '')"
    line = lambda role: f"(chr(10) || {role} || ':' || e[1].t)"
    made = {1: (3, "'user'"), 2: (3, "'user'"), 3: (4, "'assistant'"), 4: (3, "'user'")}
    kept = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
    late = "CASE WHEN e[1].c = 3 THEN 1 ELSE 0 END"
    ways = []
    for state, (to, role) in made.items():
        keep = " ".join(f"WHEN e[1].c IN (0, 3) AND e[1].a = '{r}' THEN {way(late, 'K', k, line('e[1].x'))}" for r, k in kept[state].items())
        turn = f"WHEN e[1].c IN (0, 3) AND e[1].a <> left({role}, 1) THEN {way('2 + ' + late, 'R', to, line(role))}"
        ways.append(f"list_min(list_filter([{way(3, 'D', state)}, CASE {keep} END, CASE {turn} END], lambda y: y IS NOT NULL))")
    step = f"[{', '.join(ways)}]"
    for _ in range(2):
        inserted = ", ".join(f"least_of(w[{s}], struct_pack(c := w[{to}].c + 2, a := 'I' || w[{to}].a, x := chr(10) || {role} || ':' || w[{to}].x, t := ''))" for s, (to, role) in made.items())
        step = f"list_transform([{step}], lambda w: [{inserted}])[1]".replace("least_of(", "list_min([").replace("t := ''))", "t := '')])")
    return step


REPAIR_SQL = REPAIR_SQL.replace("{step}", _fold_sql())


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query()
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").filter(fold() != 0)
    scored = quality.quality_scores(table(spark, folder, "documents"), labels)
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query(REPEATS_SQL)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.without_repeats(table(spark, folder, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(RULES_SQL)
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(table(spark, folder, "documents")).drop("n_left")


@query()
def op4_language_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return language.text_scores(table(spark, folder, "documents"))


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").filter(fold() != 0).select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    scored = toxicity.toxicity(table(spark, folder, "documents"), labels, ["low_quality", "toxic"])
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "low_quality", "toxic", "predicted")


@query()
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return secret_scan.secret_spans(documents, secret_scan.labelled_by_patterns(documents))


@query()
def op7_token_output(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), path, vocabulary())
    return tokens.token_digests(spark, path)


@query(LINKS_SQL)
def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked_components(table(spark, folder, "documents")).drop("_row")


@query()
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    drawn = mixing.mixture(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return drawn.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                        (F.col("_size") * F.size("_takes")).alias("taken"))


@query(CONTAINED_SQL)
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def with_periods(documents: DataFrame) -> DataFrame:
    """A tenth of the documents, chosen by their id, with their words repeated periodically from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n = F.size("_words")
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    repeated = F.transform("_words", lambda word, i: F.when(i < F.col("_a"), word).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    rows = documents.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), F.floor(h / 10).alias("_g"))
    rows = rows.select("doc_id", "text", "_words", F.when(n > 0, a).alias("_a"), F.when(n > 0, p).alias("_p"))
    return rows.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query(RUNS_SQL)
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(with_periods(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(F.expr("1000 * _best.length div -_best.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query()
def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = language_id.languages(documents, language_id.fit(documents.filter(~held & F.col("lang").isNotNull())))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of conversation and turn: dropped, emptied, cut, repeated and mislabelled rows."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("_fault")).filter("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


@query(REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    summary, rows = conversations.repaired(with_damage(turns))
    found = conversations.keyed(turns.select("conv_id").distinct(), summary, ["conv_id"], "left")
    found = conversations.keyed(found, conversations.digests(rows), ["conv_id"], "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
