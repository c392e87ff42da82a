"""Queries of the language model and the lexicon, each with its SQL: n-grams, families, probabilities, context evidence, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.functions.unicode import accent_key, nfc, words
from sieveloom.operators import evidence as ev
from sieveloom.operators import lexicon as lx
from sieveloom.operators import ngrams as ng
from sieveloom.operators.common import materialize
from sieveloom.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words of the lines of the corrected messages, once a record."""
    return ng.lines(spread(table(spark, d, "sms_dataset").select("row_id", "clean").filter("clean is not null")).distinct(), "clean", "row_id")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return ng.lines(spread(table(spark, d, "documents").select("doc_id", "text").filter("text is not null")), "text", "doc_id")


def r6(c) -> F.Column:
    """Rounded half up to six places, as on both sides of a comparison."""
    return F.floor(c * 1e6 + 0.5) / 1e6


_W = r"regexp_extract_all(lower(nfc_normalize({0})), '[\p{{L}}\p{{M}}]+')"
_KEY = "replace(strip_accents({0}), 'đ', 'd')"
_DOCS = f"docl AS (SELECT doc_id, {_W.format('line')} AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL))"
_CLEAN = f"clnl AS (SELECT row_id, {_W.format('line')} AS words FROM (SELECT row_id, unnest(string_split(clean, chr(10))) AS line FROM (SELECT DISTINCT row_id, clean FROM sms_dataset WHERE clean IS NOT NULL)))"


def _grams(src: str, n: int, weight: str = "1") -> str:
    return f"SELECT gram, CAST(sum(w) AS BIGINT) AS c FROM (SELECT {weight} AS w, unnest(list_transform(range(1, len(words) - {n} + 2), lambda i: array_to_string(words[i:i + {n - 1}], ' '))) AS gram FROM {src} WHERE len(words) >= {n}) GROUP BY gram"


@query(f"WITH {_DOCS} SELECT * FROM ({_grams('docl', 1)}) WHERE c >= 2")
def ngram_uni(spark, d):
    return ng.count_grams(document_lines(spark, d), 1).filter("c >= 2")


@query(f"WITH {_DOCS} SELECT * FROM ({_grams('docl', 2)}) WHERE c >= 2")
def ngram_bi(spark, d):
    return ng.count_grams(document_lines(spark, d), 2).filter("c >= 2")


@query(f"WITH {_DOCS} SELECT * FROM ({_grams('docl', 3)}) WHERE c >= 3")
def ngram_tri(spark, d):
    return ng.count_grams(document_lines(spark, d), 3).filter("c >= 3")


@query(f"WITH {_CLEAN} SELECT * FROM ({_grams('clnl', 3)}) ORDER BY c DESC, gram DESC LIMIT 2000")
def ngram_top(spark, d):
    return ng.top(ng.count_grams(clean_lines(spark, d), 3), 2000)


def weighted_lines(spark, d) -> DataFrame:
    """Distinct lines of both sources; a line of the corrected messages weighs 3 wherever else it stands, one of the documents alone 1."""
    both = clean_lines(spark, d).select(F.lit(0).alias("rnk"), "words").unionByName(document_lines(spark, d).select(F.lit(1).alias("rnk"), "words"))
    return both.groupBy("words").agg(F.min("rnk").alias("rnk")).select("words", F.when(F.col("rnk") == 0, 3).otherwise(1).alias("weight"))


_WEIGHTED = f"{_CLEAN}, {_DOCS}, weighted AS (SELECT words, CASE WHEN min(rnk) = 0 THEN 3 ELSE 1 END AS weight FROM (SELECT 0 AS rnk, words FROM clnl WHERE len(words) > 0 UNION ALL SELECT 1, words FROM docl WHERE len(words) > 0) GROUP BY words)"


@query(f"WITH {_WEIGHTED} SELECT * FROM ({_grams('weighted', 1, 'weight')}) WHERE c >= 2")
def ngram_weighted(spark, d):
    return ng.count_grams(weighted_lines(spark, d), 1, F.col("weight")).filter("c >= 2")


def model(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unigrams, bigrams and trigrams of the corrected messages."""
    rows = materialize(clean_lines(spark, d), "lines")
    return tuple(ng.count_grams(rows, n) for n in (1, 2, 3))


def counted(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same as tables, for plans that ask for them several times."""
    return tuple(materialize(x, "grams") for x in model(spark, d))


_MODEL = f"{_CLEAN}, u AS ({_grams('clnl', 1)}), b AS ({_grams('clnl', 2)}), t AS ({_grams('clnl', 3)})"


@query(f"WITH {_MODEL}, v AS (SELECT gram FROM u WHERE c >= 5) SELECT gram, c FROM (SELECT *, string_split(gram, ' ') AS w FROM b) WHERE w[1] IN (SELECT gram FROM v) AND w[2] IN (SELECT gram FROM v)")
def ngram_vocab(spark, d):
    u, b, _ = model(spark, d)
    return ng.in_vocabulary(b, 2, u.filter("c >= 5"))


@query(f"""WITH {_MODEL}, kept AS (SELECT gram, c FROM t ORDER BY c DESC, gram DESC LIMIT 2000), centres AS (SELECT gram FROM u WHERE c BETWEEN 2 AND 20)
SELECT gram, c FROM kept UNION ALL SELECT gram, c FROM t WHERE c < (SELECT min(c) FROM kept) AND string_split(gram, ' ')[2] IN (SELECT gram FROM centres)""")
def evidence_retention(spark, d):
    u, _, t = model(spark, d)
    return ng.retain_evidence(t, ng.top(t, 2000), u.filter("c between 2 and 20"))


@query(f"""WITH {_MODEL}, p AS (SELECT gram, c, string_split(gram, ' ') AS w FROM t WHERE c >= 2)
SELECT gram, CAST(max(c) AS BIGINT) AS c FROM (SELECT gram, c FROM b WHERE c >= 3 UNION ALL SELECT w[1] || ' ' || w[2], sum(c) FROM p GROUP BY 1 UNION ALL SELECT w[2] || ' ' || w[3], sum(c) FROM p GROUP BY 1) GROUP BY gram""")
def backoff_repair(spark, d):
    _, b, t = model(spark, d)
    return ng.repair_backoff(b.filter("c >= 3"), t.filter("c >= 2"))


_FAM = f"{_MODEL}, fam AS (SELECT {_KEY.format('gram')} AS akey, gram, c, row_number() OVER (PARTITION BY {_KEY.format('gram')} ORDER BY c DESC, gram) AS rnk FROM u)"


def fams(spark, d) -> DataFrame:
    return ng.families(model(spark, d)[0], accent_key)


@query(f"WITH {_FAM} SELECT akey, gram, c, rnk, floor(c / sum(c) OVER (PARTITION BY akey) * 1e6 + 0.5) / 1e6 AS share FROM fam QUALIFY count(*) OVER (PARTITION BY akey) >= 2")
def fam_top(spark, d):
    by = Window.partitionBy("akey")
    return fams(spark, d).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("share", r6(F.col("c") / F.sum("c").over(by))).filter("n >= 2").drop("n")


@query(f"WITH {_FAM} SELECT akey, gram, c, rnk FROM fam WHERE rnk <= 12")
def fam_cap12(spark, d):
    return ng.families(model(spark, d)[0], accent_key, 12)


@query(f"WITH {_FAM} SELECT akey, max(c) AS strongest, count(*) AS members, bool_or(gram <> akey) AS accented FROM fam GROUP BY akey")
def group_summary(spark, d):
    return fams(spark, d).groupBy("akey").agg(F.max("c").alias("strongest"), F.count(F.lit(1)).alias("members"), F.bool_or(F.col("gram") != F.col("akey")).alias("accented"))


_P = """m AS (SELECT sum(c) AS total, count(*) AS voc FROM u), s AS (SELECT t.gram, t.c AS c3, string_split(t.gram, ' ') AS w FROM t),
j AS (SELECT s.gram, s.c3, coalesce(x.c, 0) AS c12, coalesce(y.c, 0) AS c23, coalesce(u2.c, 0) AS c2, coalesce(u3.c, 0) AS cu, m.* FROM s CROSS JOIN m LEFT JOIN b x ON x.gram = w[1] || ' ' || w[2] LEFT JOIN b y ON y.gram = w[2] || ' ' || w[3] LEFT JOIN u u2 ON u2.gram = w[2] LEFT JOIN u u3 ON u3.gram = w[3]),
p AS (SELECT *, (cu + 0.5::DOUBLE) / (total + 0.5::DOUBLE * voc) AS p1 FROM j), q AS (SELECT *, CASE WHEN c2 > 0 THEN (c23 + 2 * p1) / (c2 + 2) ELSE p1 END AS p2 FROM p)"""


@query(f"WITH {_MODEL}, {_P} SELECT gram, c3, c12, c23, floor(p1 * 1e9 + 0.5) / 1e9 AS p1, floor(p2 * 1e6 + 0.5) / 1e6 AS p2, floor((c3 + p2) / (c12 + 1) * 1e6 + 0.5) / 1e6 AS p3 FROM q")
def lm_probabilities(spark, d):
    return ng.scored(*counted(spark, d)).select("gram", "c3", "c12", "c23", (F.floor(F.col("p1") * 1e9 + 0.5) / 1e9).alias("p1"), r6(F.col("p2")).alias("p2"), r6(F.col("p3")).alias("p3"))


def tokens(spark, d) -> DataFrame:
    """(run_id, word_idx, word) and two neighbours on each side, of the messages of special_case_results."""
    runs = table(spark, d, "special_case_results").select("run_id", F.col("result.input_text").alias("text"), "result.message_mode").filter("text is not null").distinct()
    rows = runs.select("run_id", "message_mode", F.posexplode(words(nfc("text"))).alias("word_idx", "word"))
    by = Window.partitionBy("run_id").orderBy("word_idx")
    return rows.select("*", *[f("word", n).over(by).alias(name) for name, f, n in (("prev2", F.lag, 2), ("prev1", F.lag, 1), ("next1", F.lead, 1), ("next2", F.lead, 2))])


_TOK = f"""runs AS (SELECT DISTINCT run_id, result.input_text AS text, result.message_mode AS message_mode FROM special_case_results WHERE result.input_text IS NOT NULL),
tw AS (SELECT run_id, message_mode, {_W.format('text')} AS ws FROM runs), te AS (SELECT run_id, message_mode, ws, unnest(range(1, len(ws) + 1)) AS i FROM tw),
tok AS (SELECT run_id, message_mode, CAST(i - 1 AS INT) AS word_idx, ws[i] AS word, CASE WHEN i > 2 THEN ws[i - 2] END AS prev2, CASE WHEN i > 1 THEN ws[i - 1] END AS prev1, ws[i + 1] AS next1, ws[i + 2] AS next2 FROM te)"""


@query(f"WITH {_TOK} SELECT run_id, word_idx, word, prev2, prev1, next1, next2 FROM tok")
def neighbours(spark, d):
    return tokens(spark, d).drop("message_mode")


def evidence(spark, d) -> DataFrame:
    """Context evidence for each sibling spelling against each written word, by distinct context."""
    u, b, t = counted(spark, d)
    fam = ng.families(u, accent_key, 12)
    at = tokens(spark, d).select("word", "prev2", "prev1", "next1", "next2").distinct()
    keys = at.select("word").distinct().withColumn("akey", accent_key("word"))
    rows = at.join(keys, "word").join(fam.select("akey", F.col("gram").alias("cand")), "akey").filter("cand <> word")
    rows = ev.attest(rows, (u, b, t))
    return rows.select("word", "prev2", "prev1", "next1", "next2", "cand", *[r6(x).alias(f"{n}_ratio") for n, x in ev.ratios().items()], ev.attested("cand").alias("cand_windows"), ev.attested("word").alias("word_windows"), r6(ev.score()).alias("score"))


def _evidence_sql() -> str:
    grams = {"uni": ("{w}", "u"), "left": ("prev1 || ' ' || {w}", "b"), "right": ("{w} || ' ' || next1", "b"), "mid": ("prev1 || ' ' || {w} || ' ' || next1", "t"), "fwd": ("{w} || ' ' || next1 || ' ' || next2", "t"), "back": ("prev2 || ' ' || prev1 || ' ' || {w}", "t")}
    joins, cols = [], []
    for s in ("cand", "word"):
        for n, (g, src) in grams.items():
            joins.append(f"LEFT JOIN {src} {n}_{s} ON {n}_{s}.gram = {g.format(w='r.' + s)}")
            cols.append(f"coalesce({n}_{s}.c, 0) AS {n}_{s}")
    ratio = lambda n: f"(ln(1 + {n}_cand) - ln(1 + {n}_word))"
    att = lambda s: " + ".join(f"({n}_{s} > 0)::INT" for n in ("left", "right", "mid", "fwd", "back"))
    score = " + ".join(f"{w} * {ratio(n)}" for n, w in (("uni", 0.25), ("left", 0.5), ("right", 0.5), ("mid", 1.0), ("fwd", 1.0), ("back", 1.0)))
    return (
        f"WITH {_FAM}, {_TOK}, ctx AS (SELECT DISTINCT word, prev2, prev1, next1, next2 FROM tok), r AS (SELECT ctx.*, fam.gram AS cand FROM ctx JOIN fam ON fam.akey = {_KEY.format('ctx.word')} AND fam.rnk <= 12 AND fam.gram <> ctx.word), "
        f"x AS (SELECT r.*, {', '.join(cols)} FROM r {' '.join(joins)}) SELECT word, prev2, prev1, next1, next2, cand, "
        + ", ".join(f"floor({ratio(n)} * 1e6 + 0.5) / 1e6 AS {n}_ratio" for n in grams)
        + f", {att('cand')} AS cand_windows, {att('word')} AS word_windows, floor(({score}) * 1e6 + 0.5) / 1e6 AS score FROM x"
    )


@query(_evidence_sql())
def ctx_evidence(spark, d):
    return evidence(spark, d)


@query(f"""WITH {_FAM}, {_TOK}, m AS (SELECT sum(c) AS total, count(*) AS voc FROM u), ctx AS (SELECT DISTINCT word, prev1, next1 FROM tok),
r AS (SELECT ctx.*, fam.gram AS cand, fam.rnk, (fam.c + 0.5::DOUBLE) / (total + 0.5::DOUBLE * voc) AS pc, CASE WHEN un.c IS NOT NULL THEN (un.c + 0.5::DOUBLE) / (total + 0.5::DOUBLE * voc) END AS pn, up.c AS cp, fam.c AS cc, coalesce(l.c, 0) AS lb, coalesce(n.c, 0) AS rb
 FROM ctx CROSS JOIN m JOIN fam ON fam.akey = {_KEY.format('ctx.word')} AND fam.rnk <= 12 LEFT JOIN u up ON up.gram = prev1 LEFT JOIN u un ON un.gram = next1 LEFT JOIN b l ON l.gram = prev1 || ' ' || fam.gram LEFT JOIN b n ON n.gram = fam.gram || ' ' || next1),
s AS (SELECT *, CASE WHEN cp IS NOT NULL THEN ln(greatest((lb + 2 * pc) / (cp + 2), 1e-12)) ELSE 0 END + CASE WHEN pn IS NOT NULL THEN ln(greatest((rb + 2 * pn) / (cc + 2), 1e-12)) ELSE 0 END AS sc FROM r)
SELECT word, prev1, next1, cand AS best FROM s QUALIFY row_number() OVER (PARTITION BY word, prev1, next1 ORDER BY floor(sc * 1e6 + 0.5) DESC, rnk) = 1""")
def resolve_ctx(spark, d):
    """The spelling that fits best between the neighbours as written, by smoothed bigrams; ties go to the more frequent."""
    u, b, _ = counted(spark, d)
    fam = ng.families(u, accent_key, 12)
    meta = u.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("voc"))
    at = tokens(spark, d).select("word", "prev1", "next1").distinct()
    keys = at.select("word").distinct().withColumn("akey", accent_key("word"))
    r = at.join(keys, "word").join(fam.select("akey", F.col("gram").alias("cand"), F.col("c").alias("cc"), "rnk"), "akey").join(F.broadcast(meta))
    r = r.join(u.select(F.col("gram").alias("prev1"), F.col("c").alias("cp")), "prev1", "left").join(u.select(F.col("gram").alias("next1"), F.col("c").alias("cn")), "next1", "left")
    r = r.withColumn("lg", F.concat("prev1", F.lit(" "), "cand")).withColumn("rg", F.concat("cand", F.lit(" "), "next1"))
    r = r.join(b.select(F.col("gram").alias("lg"), F.col("c").alias("lb")), "lg", "left").join(b.select(F.col("gram").alias("rg"), F.col("c").alias("rb")), "rg", "left").fillna(0, ["lb", "rb"])
    pc, pn = (ng.p_uni(F.col(c), F.col("total"), F.col("voc")) for c in ("cc", "cn"))
    left = F.when(F.col("cp").isNotNull(), F.log(F.greatest((F.col("lb") + ng.ALPHA * pc) / (F.col("cp") + ng.ALPHA), F.lit(1e-12)))).otherwise(0.0)
    right = F.when(F.col("cn").isNotNull(), F.log(F.greatest((F.col("rb") + ng.ALPHA * pn) / (F.col("cc") + ng.ALPHA), F.lit(1e-12)))).otherwise(0.0)
    best = F.min_by("cand", F.struct(-F.floor((left + right) * 1e6 + 0.5), F.col("rnk")))
    return r.groupBy("word", "prev1", "next1").agg(best.alias("best"))


@query(f"""WITH {_FAM}, g AS (SELECT akey, gram, ln(c) AS s, max(ln(c)) OVER (PARTITION BY akey) AS mx, rnk FROM fam), e AS (SELECT akey, gram, rnk, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY akey) AS p FROM g)
SELECT x.akey, x.gram AS best, floor(x.p * 1e6 + 0.5) / 1e6 AS confidence, floor((x.p - coalesce(y.p, 0)) * 1e6 + 0.5) / 1e6 AS margin FROM e x LEFT JOIN e y ON y.akey = x.akey AND y.rnk = 2 WHERE x.rnk = 1""")
def softmax_margin(spark, d):
    """Softmax over each family's log counts: the best spelling, its probability and its margin to the second."""
    by = Window.partitionBy("akey")
    g = fams(spark, d).withColumn("s", F.log("c")).withColumn("e", F.exp(F.col("s") - F.max("s").over(by))).withColumn("p", F.col("e") / F.sum("e").over(by))
    return g.groupBy("akey").agg(F.max(F.when(F.col("rnk") == 1, F.col("gram"))).alias("best"), F.max(F.when(F.col("rnk") == 1, F.col("p"))).alias("p1"), F.coalesce(F.max(F.when(F.col("rnk") == 2, F.col("p"))), F.lit(0.0)).alias("p2")).select("akey", "best", r6(F.col("p1")).alias("confidence"), r6(F.col("p1") - F.col("p2")).alias("margin"))


def lexicon(spark, d) -> DataFrame:
    """Words of the corrected messages with those of the templates as curated source; words of one letter are stop words."""
    corpus = model(spark, d)[0].select(F.col("gram").alias("word"), F.col("c").alias("freq")).filter("freq >= 2")
    curated = table(spark, d, "templates").filter("text is not null").select(F.explode(words(nfc("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    stop = corpus.select("word").union(curated.select("word")).filter(F.length("word") == 1)
    return lx.merge(corpus, curated, stop)


_LEX = f"""cor AS (SELECT gram AS word, c AS freq FROM u WHERE c >= 2), cur AS (SELECT word, count(*) AS freq FROM (SELECT unnest({_W.format('text')}) AS word FROM templates WHERE text IS NOT NULL) GROUP BY word),
lex AS (SELECT coalesce(cor.word, cur.word) AS word, coalesce(cor.freq, cur.freq) AS freq, CASE WHEN cor.word IS NOT NULL AND cur.word IS NOT NULL THEN 'both' WHEN cor.word IS NOT NULL THEN 'corpus' ELSE 'curated' END AS src FROM cor FULL JOIN cur ON cor.word = cur.word WHERE length(coalesce(cor.word, cur.word)) <> 1)"""


@query(f"WITH {_MODEL}, {_LEX} SELECT word, freq, src FROM lex")
def lexicon_merge(spark, d):
    return lexicon(spark, d)


@query(f"""WITH {_FAM}, {_LEX}, {_TOK}, sib AS (SELECT akey, count(*) AS members, max((gram <> akey)::INT) AS accented FROM fam GROUP BY akey),
k AS (SELECT tok.word, message_mode, {_KEY.format('tok.word')} AS akey FROM tok),
c AS (SELECT message_mode, CASE WHEN k.word IN (SELECT DISTINCT lower(brand) FROM corpus WHERE brand IS NOT NULL) THEN 'WHITELISTED' WHEN regexp_matches(k.word, '[0-9]') THEN 'CODE_LIKE'
 WHEN coalesce(lex.freq, 0) > 0 AND lex.src <> 'curated' AND NOT (message_mode IS NOT DISTINCT FROM 'ACCENTED' AND k.word = k.akey AND coalesce(accented, 0) > 0) THEN 'DICTIONARY' WHEN k.word = k.akey AND coalesce(members, 0) > 0 THEN 'UNACCENTED_VALID' ELSE 'UNKNOWN' END AS class
 FROM k LEFT JOIN sib USING (akey) LEFT JOIN lex ON lex.word = k.word) SELECT message_mode, class, count(*) AS n FROM c GROUP BY ALL""")
def classify_tokens(spark, d):
    tok = tokens(spark, d).select("word", F.col("message_mode"), F.coalesce("message_mode", F.lit("")).alias("mode"), F.lit(False).alias("protected"))
    allowed = table(spark, d, "corpus").select(F.lower("brand").alias("word")).dropna().distinct()
    return lx.classify(tok, lexicon(spark, d), fams(spark, d), allowed).groupBy("message_mode", "class").agg(F.count(F.lit(1)).alias("n"))


_VOC = f"{_MODEL}, voc AS (SELECT gram AS word, c AS freq FROM u WHERE c >= 2)"
_DEL = "list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))"


def vocabulary(spark, d) -> DataFrame:
    return model(spark, d)[0].filter("c >= 2").select(F.col("gram").alias("word"), F.col("c").alias("freq"))


@query(f"WITH {_VOC} SELECT unnest({_DEL}) AS variant, word FROM voc")
def delete_index(spark, d):
    return lx.delete_index(vocabulary(spark, d))


def unknown_words(spark, d) -> DataFrame:
    return tokens(spark, d).select("word").distinct().join(vocabulary(spark, d), "word", "left_anti")


_UNK = f"{_VOC}, {_TOK}, unk AS (SELECT DISTINCT word FROM tok WHERE word NOT IN (SELECT word FROM voc))"
_POOL = f"""{_UNK}, vi AS (SELECT unnest({_DEL}) AS variant, word FROM voc), ui AS (SELECT unnest({_DEL}) AS variant, word AS input FROM unk),
pl AS (SELECT DISTINCT input, vi.word FROM ui JOIN vi USING (variant) WHERE input <> vi.word), pool AS (SELECT input, pl.word, freq FROM pl JOIN voc ON voc.word = pl.word)"""


@query(f"WITH {_POOL} SELECT input, word, freq FROM pool")
def sym_pool(spark, d):
    return lx.pool(unknown_words(spark, d), vocabulary(spark, d)).select("input", "word", "freq")


@query()
def sym_ranked(spark, d):
    """The pool with alignment distance, cheap score and both ranks; tested against brute force."""
    return lx.ranked(lx.pool(unknown_words(spark, d), materialize(vocabulary(spark, d), "vocabulary")))


@query(f"""WITH {_UNK}, cuts AS (SELECT word, unnest(range(1, length(word))) AS k FROM unk), sp AS (SELECT word, substr(word, 1, k) AS l, substr(word, k + 1) AS r FROM cuts)
SELECT sp.word, sp.l AS "left", sp.r AS "right", least(a.freq, z.freq) AS lowest, CAST(row_number() OVER (PARTITION BY sp.word ORDER BY least(a.freq, z.freq) DESC, sp.l) AS INT) AS rnk FROM sp JOIN voc a ON a.word = sp.l AND a.freq >= 20 JOIN voc z ON z.word = sp.r AND z.freq >= 20 QUALIFY rnk <= 4""")
def word_split(spark, d):
    return lx.word_splits(unknown_words(spark, d), vocabulary(spark, d), 20)


@query(f"WITH {_VOC}, {_TOK} SELECT DISTINCT tok.word AS w1, next1 AS w2, tok.word || next1 AS merged, voc.freq AS freq FROM tok JOIN voc ON voc.word = tok.word || next1 AND voc.freq >= 20")
def word_merge(spark, d):
    return lx.word_merges(tokens(spark, d).filter("next1 is not null").select(F.col("word").alias("w1"), F.col("next1").alias("w2")), vocabulary(spark, d), 20)


@query(f"WITH {_MODEL} SELECT gram AS word, c AS n, CAST(7 + row_number() OVER (ORDER BY c DESC, gram) AS BIGINT) AS id FROM u WHERE c >= 3")
def vocab_ids(spark, d):
    """Ids from 8 on by falling frequency. The ranking runs over ranges of counts, so that no task sorts the whole vocabulary."""
    u = model(spark, d)[0].filter("c >= 3")
    sizes = u.groupBy("c").agg(F.count(F.lit(1)).alias("n_c"))  # one row a distinct count: at most sqrt(2 n) for n words in all
    above = sizes.withColumn("before", F.coalesce(F.sum("n_c").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_c")
    return u.join(above, "c").select(F.col("gram").alias("word"), F.col("c").alias("n"), (F.lit(7) + F.col("before") + F.row_number().over(Window.partitionBy("c").orderBy("gram"))).cast("long").alias("id"))


@query(f"""WITH {_VOC}, s AS (SELECT '<' || word || '>' AS w, word FROM voc), g AS (SELECT DISTINCT word, substr(w, i, k) AS g FROM (SELECT word, w, unnest(range(1, length(w) + 1)) AS i FROM s) CROSS JOIN (SELECT unnest([2, 3, 4]) AS k) WHERE i + k - 1 <= length(w))
SELECT g AS gram, count(*) AS words FROM g GROUP BY g""")
def char_ngrams(spark, d):
    """Number of words that hold each run of two to four characters, with marked ends."""
    w = vocabulary(spark, d).select(F.concat(F.lit("<"), "word", F.lit(">")).alias("w"))

    def runs(k: int) -> F.Column:
        return F.when(F.length("w") >= k, F.transform(F.sequence(F.lit(1), F.length("w") - (k - 1)), lambda i: F.substring("w", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    g = w.select(F.explode(F.array_distinct(F.concat(*map(runs, (2, 3, 4))))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
