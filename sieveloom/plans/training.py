"""Queries of training and decisions: features, weights, shortlists, budgets, damage, overlays, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.functions.unicode import accent_key, fold_key, nfc, osa_distance, words
from sieveloom.operators import evidence, training
from sieveloom.operators import ngrams as ng
from sieveloom.operators.common import materialize
from sieveloom.plans import language, prep
from sieveloom.plans.language import r6
from sieveloom.functions.keys import key
from sieveloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FEATURES = ("uni_ratio", "left_ratio", "right_ratio", "mid_ratio", "fwd_ratio", "back_ratio", "cand_windows", "word_windows")
_EV = f"ev AS ({language.SQL['ctx_evidence']})"


@query("WITH " + _EV + " " + " UNION ALL ".join(f"SELECT '{n}' AS feature, floor(avg({n}) * 1e6 + 0.5) / 1e6 AS mean, floor(CASE WHEN stddev_pop({n}) = 0 THEN 1 ELSE stddev_pop({n}) END * 1e6 + 0.5) / 1e6 AS std FROM ev" for n in _FEATURES))
def feature_stats(spark, d):
    return training.feature_stats(language.evidence(spark, d), list(_FEATURES)).select("feature", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


#: Weights of our own, to show the expression (name -> weight, mean, std).
DEMO = {"uni_ratio": (0.4, 0.0, 1.0), "left_ratio": (0.8, 0.5, 2.0), "right_ratio": (0.8, 0.5, 2.0), "mid_ratio": (1.2, 0.2, 1.0), "cand_windows": (0.5, 1.0, 1.5), "word_windows": (-0.5, 1.0, 1.5)}
_LOGIT = " + ".join(f"{w} * (({n} - {m}) / {s})" for n, (w, m, s) in DEMO.items())


@query(f"WITH {_EV} SELECT word, prev2, prev1, next1, next2, cand, floor(1 / (1 + exp(-greatest(least(CAST({_LOGIT} AS DOUBLE), 36), -36))) * 1e6 + 0.5) / 1e6 AS p FROM ev")
def pairwise_logit(spark, d):
    return language.evidence(spark, d).select("word", "prev2", "prev1", "next1", "next2", "cand", r6(training.logistic(training.logit(DEMO))).alias("p"))


def pairwise_rows(spark, d) -> DataFrame:
    """Labelled pairs of the training split: each error of one word with its correction (true) and the three most frequent other spellings of its key (false), with their evidence."""
    rows = table(spark, d, "sms_dataset").filter(key("split") == "train").dropDuplicates(["row_id"]).filter("text is not null")
    at = rows.select("row_id", F.posexplode(words(nfc("text"))).alias("idx", "word"))
    by = Window.partitionBy("row_id").orderBy("idx")
    at = at.select("*", *[f("word", n).over(by).alias(name) for name, f, n in (("prev2", F.lag, 2), ("prev1", F.lag, 1), ("next1", F.lead, 1), ("next2", F.lead, 2))])
    gold = prep.pairs(spark, d, "train").select("row_id", F.size(F.regexp_extract_all(nfc(F.expr("substring(text, 1, char_start)")), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("idx"), F.lower("correction").alias("target"), F.lower("error").alias("word")).filter("not target like '% %' and not word like '% %'")
    errors = at.join(gold, ["row_id", "idx", "word"]).withColumn("akey", accent_key("word"))
    u, b, t = language.model(spark, d)
    fam = ng.families(u, accent_key, 4).select("akey", F.col("gram").alias("cand"), "rnk")
    good = errors.select("row_id", "idx", "word", "prev2", "prev1", "next1", "next2", F.col("target").alias("cand"), F.lit(True).alias("label"))
    hard = errors.join(fam, "akey").filter("cand <> target and cand <> word").withColumn("n", F.row_number().over(Window.partitionBy("row_id", "idx").orderBy("rnk"))).filter("n <= 3").select("row_id", "idx", "word", "prev2", "prev1", "next1", "next2", "cand", F.lit(False).alias("label"))
    got = evidence.attest(good.unionByName(hard), (u, b, t))
    return got.select("row_id", "idx", "word", "cand", "label", *[x.alias(f"{n}_ratio") for n, x in evidence.ratios().items()], evidence.attested("cand").alias("cand_windows"), evidence.attested("word").alias("word_windows"))


@query()
def pairwise_features(spark, d):
    """Feature rows of labelled pairs, for training."""
    return pairwise_rows(spark, d)


@query()
def logistic_weights(spark, d):
    """Balanced logistic weights of the pairwise features."""
    return training.fit_logistic(materialize(pairwise_rows(spark, d), "pairs"), list(_FEATURES), "label")


@query(f"WITH {prep._GUESS} SELECT profile, count(*) AS n, CAST(sum(ok::INT) AS BIGINT) AS pos, floor(count(*) / (2 * nullif(sum(ok::INT), 0)) * 1e6 + 0.5) / 1e6 AS w_pos, floor(count(*) / (2 * nullif(count(*) - sum(ok::INT), 0)) * 1e6 + 0.5) / 1e6 AS w_neg FROM gs GROUP BY profile")
def class_weights(spark, d):
    g = prep.guesses(spark, d).groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("pos"))
    return g.select("profile", "n", "pos", r6(F.try_divide(F.col("n"), 2 * F.col("pos"))).alias("w_pos"), r6(F.try_divide(F.col("n"), 2 * (F.col("n") - F.col("pos")))).alias("w_neg"))


@query()
def shortlists(spark, d):
    """Diverse shortlists of four of the ranked pool of unknown words; tested against the step-by-step choice."""
    pool = language.lx.ranked(language.lx.pool(language.unknown_words(spark, d), language.vocabulary(spark, d)))
    p = pool.select("input", F.col("word").alias("cand"), F.col("osa").alias("dist"), "freq", "same", (F.col("freq") >= 20).alias("attested"), F.log1p("freq").alias("recall"), "cheap_rank")
    return training.shortlist(p, ["input"], 4).select("input", "cand", "pos")


@query()
def group_admission(spark, d):
    """Families that fit a budget of a third of all spellings, accented ones first, at most six spellings each."""
    g = materialize(language.fams(spark, d).groupBy(F.col("akey").alias("key")).agg(F.bool_or(F.col("gram") != F.col("akey")).alias("first"), F.max("c").alias("strongest"), F.least(F.count(F.lit(1)), F.lit(6)).alias("size")), "groups")
    budget = (g.agg(F.sum("size")).first()[0] or 0) // 3
    return training.admit(g, budget)


_SLOT = rf"""tg AS (SELECT DISTINCT row_id, CAST(len(regexp_extract_all(substr(text, 1, char_start), '[\p{{L}}\p{{M}}]+')) AS INT) AS target FROM pr), wl AS (SELECT row_id, regexp_extract_all(text, '[\p{{L}}\p{{M}}]+') AS ws FROM (SELECT DISTINCT ON (row_id) * FROM sms_dataset)),
xs AS (SELECT tg.row_id, target, ws, CAST(unnest(range(0, len(ws))) AS INT) AS idx FROM tg JOIN wl USING (row_id))"""


@query(f"WITH {prep._PAIRS}, {_SLOT}, k AS (SELECT row_id, target, idx, ws[idx + 1] AS word FROM xs QUALIFY row_number() OVER (PARTITION BY row_id, target ORDER BY CASE WHEN idx < 4 OR idx = target THEN 0 ELSE 1 END, abs(idx - target), idx) <= 32) SELECT *, CAST(row_number() OVER (PARTITION BY row_id, target ORDER BY idx) - 1 AS INT) AS slot FROM k")
def ctx_slots32(spark, d):
    """Context of each labelled word: at most 32 words."""
    pat = F.lit(r"[\p{L}\p{M}]+")
    target = prep.pairs(spark, d).select("row_id", F.size(F.regexp_extract_all(F.expr("substring(text, 1, char_start)"), pat, F.lit(0))).alias("target")).distinct()
    rows = table(spark, d, "sms_dataset").dropDuplicates(["row_id"]).select("row_id", F.posexplode(F.regexp_extract_all("text", pat, F.lit(0))).alias("idx", "word"))
    return training.context_slots(rows.join(target, "row_id"), ["row_id"], "target", "idx").select("row_id", "target", "idx", "word", "slot")


@query(f"""WITH {language._VOC}, s AS (SELECT word, '<' || word || '>' AS w FROM voc), g AS (SELECT word, list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4))) AS l FROM s),
f AS (SELECT word, list_filter(l, lambda x, i: list_position(l, x) = i)[1:32] AS l FROM g), x AS (SELECT word, unnest(l) AS r, generate_subscripts(l, 1) - 1 AS pos FROM f),
h AS (SELECT word, pos, hex(encode(r)) AS hx FROM x)
SELECT word, CAST(pos AS INT) AS pos, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(0, length(hx) // 2), lambda i: (strpos('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 17)::UBIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296) % 4096 AS INT) AS bucket FROM h""")
def fnv_hash(spark, d):
    """Hash buckets of the character runs of each word; tested against known values."""
    return language.vocabulary(spark, d).select("word", F.posexplode(training.char_hashes_udf("word")).alias("pos", "bucket"))


@query()
def synth_damage(spark, d):
    """Corrected messages damaged in one of five ways, with their labels; a test repairs them."""
    rows = table(spark, d, "sms_dataset").select("row_id", nfc("clean").alias("clean")).dropDuplicates(["row_id"])
    got = training.damaged(rows, "row_id", "clean", ["ALL_UNACCENTED", "SOME_UNACCENTED", "TELEX", "TYPO", "BOUNDARY"])
    return got.select("id", "kind", "text", F.size("labels").alias("labels"))


_CASE = "CASE WHEN length(e) > 1 AND upper(e) = e AND lower(e) <> e THEN upper(w) WHEN upper(substr(e, 1, 1)) = substr(e, 1, 1) AND lower(substr(e, 1, 1)) <> substr(e, 1, 1) THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END"


@query(f"WITH p AS (SELECT row_id, p.char_start AS char_start, nfc_normalize(p.error) AS e, lower(nfc_normalize(p.correction)) AS w FROM (SELECT row_id, unnest(correction_pairs) AS p FROM (SELECT DISTINCT ON (row_id) * FROM sms_dataset))) SELECT row_id, char_start, {_CASE} AS suggestion FROM p")
def case_copy(spark, d):
    """Suggestions in the case of what they replace."""
    return prep.pairs(spark, d).select("row_id", "char_start", training.match_case(F.col("error"), F.lower("correction")).alias("suggestion"))


@query("""WITH r AS (SELECT DISTINCT ON (row_id) row_id, correction_pairs, expect FROM sms_dataset), a AS (SELECT DISTINCT row_id, p.char_start AS pos FROM (SELECT row_id, unnest(correction_pairs) AS p FROM r)), b AS (SELECT DISTINCT row_id, p.position_start AS pos FROM (SELECT row_id, unnest(expect) AS p FROM r) WHERE p.position_start IS NOT NULL)
SELECT coalesce(a.row_id, b.row_id) AS row_id, coalesce(a.pos, b.pos) AS pos, a.pos IS NOT NULL AS in_pairs, b.pos IS NOT NULL AS in_expect FROM a FULL JOIN b ON a.row_id = b.row_id AND a.pos = b.pos""")
def annotation_merge(spark, d):
    """Places of corrections and of labels, merged."""
    r = table(spark, d, "sms_dataset").dropDuplicates(["row_id"])
    a = r.select("row_id", F.explode("correction_pairs").alias("p")).select("row_id", F.col("p.char_start").alias("pos"), F.lit(True).alias("a")).distinct()
    b = r.select("row_id", F.explode("expect").alias("p")).select("row_id", F.col("p.position_start").alias("pos"), F.lit(True).alias("b")).dropna().distinct()
    return a.join(b, ["row_id", "pos"], "full_outer").select("row_id", "pos", F.coalesce("a", F.lit(False)).alias("in_pairs"), F.coalesce("b", F.lit(False)).alias("in_expect"))


_DOMAIN = f"dl AS (SELECT row_id, {language._W.format('line')} AS words FROM (SELECT row_id, unnest(string_split(clean, chr(10))) AS line FROM (SELECT DISTINCT row_id, clean FROM sms_dataset WHERE clean IS NOT NULL AND domain_name = 'banking')))"


@query(f"""WITH {language._FAM}, {_DOMAIN}, du AS ({language._grams('dl', 1)}), db AS ({language._grams('dl', 2)}), tw AS (SELECT DISTINCT fam.gram FROM fam WHERE akey IN (SELECT {language._KEY.format('gram')} FROM du)), v AS (SELECT gram FROM du UNION SELECT gram FROM tw UNION SELECT gram FROM (SELECT gram FROM u ORDER BY c DESC, gram DESC LIMIT 500))
SELECT b.gram, b.c + coalesce(db.c, 0) * 120 AS c FROM b LEFT JOIN db ON db.gram = b.gram WHERE string_split(b.gram, ' ')[1] IN (SELECT gram FROM v) AND string_split(b.gram, ' ')[2] IN (SELECT gram FROM v)""")
def domain_profile(spark, d):
    """Bigrams of a domain's profile: words of the domain, their spellings without accents and the 500 most frequent, with the domain's counts laid over 120-fold."""
    u, b, _ = language.model(spark, d)
    rows = ng.lines(table(spark, d, "sms_dataset").filter("domain_name = 'banking' and clean is not null").select("row_id", "clean").distinct(), "clean", "row_id")
    du, db = ng.count_grams(rows, 1), ng.count_grams(rows, 2)
    twins = language.fams(spark, d).join(du.select(accent_key("gram").alias("akey")).distinct(), "akey", "left_semi").select("gram")
    v = du.select("gram").union(twins).union(ng.top(u, 500).select("gram")).distinct()
    kept = ng.in_vocabulary(b, 2, v)
    return kept.join(db.select("gram", F.col("c").alias("dc")), "gram", "left").select("gram", (F.col("c") + F.coalesce("dc", F.lit(0)) * 120).alias("c"))


_K = lambda c: prep._collapse(f"lower(nfc_normalize({c}))")


@query(f"""WITH s AS (SELECT 0 AS o, 'corpus_2' AS category, {_K('text')} AS k FROM corpus_2 WHERE text IS NOT NULL UNION ALL SELECT 1, 'templates', {_K('text')} FROM templates WHERE text IS NOT NULL AND purpose = 'held_out' UNION ALL SELECT 2, 'ground_truth', {_K('result.ground_truth.clean')} FROM special_case_results WHERE result.ground_truth.clean IS NOT NULL),
f AS (SELECT k, arg_min(category, o) AS category FROM s WHERE k <> '' GROUP BY k) SELECT category, count(*) AS new_keys FROM f GROUP BY category""")
def exclusion_counts(spark, d):
    """Keys that each held-out source adds to the exclusion set, in the order of the sources."""
    parts = [
        table(spark, d, "corpus_2").select(F.lit(0).alias("o"), F.lit("corpus_2").alias("category"), F.col("text").alias("t")), table(spark, d, "templates").filter("purpose = 'held_out'").select(F.lit(1), F.lit("templates"), "text"),
        table(spark, d, "special_case_results").select(F.lit(2), F.lit("ground_truth"), "result.ground_truth.clean"),
    ]
    s = parts[0].union(parts[1]).union(parts[2]).filter("t is not null").select("o", "category", prep.prep.collapse(fold_key("t")).alias("k")).filter("k <> ''")
    return s.groupBy("k").agg(F.min_by("category", "o").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("new_keys"))


@query(f"WITH {prep._GUESS} SELECT relation, count(*) FILTER (ok AND p >= 0.8 AND NOT p >= 0.95) AS lost, count(*) FILTER (ok AND p >= 0.95) AS kept, count(*) FILTER (ok AND p < 0.8) AS never FROM gs GROUP BY relation")
def arm_transitions(spark, d):
    """Labels caught by a lenient arm and lost by a strict one, by relation."""
    g, caught = prep.guesses(spark, d), lambda c: F.sum((F.col("ok") & c).cast("long"))
    return g.groupBy("relation").agg(caught((F.col("p") >= 0.8) & (F.col("p") < 0.95)).alias("lost"), caught(F.col("p") >= 0.95).alias("kept"), caught(F.col("p") < 0.8).alias("never"))


@query(f"WITH {prep._GUESS}, m AS (SELECT sum(ok::INT) / count(guess) AS precision, sum(ok::INT) / count(*) AS recall FROM gs), g AS (SELECT 'precision >= 0.6' AS gate, floor(precision * 1e6 + 0.5) / 1e6 AS value, 0.6::DOUBLE AS \"limit\", precision >= 0.6 AS pass FROM m UNION ALL SELECT 'recall >= 0.9', floor(recall * 1e6 + 0.5) / 1e6, 0.9::DOUBLE, recall >= 0.9 FROM m) SELECT * FROM g UNION ALL SELECT 'all', NULL, NULL, bool_and(pass) FROM g")
def acceptance_gates(spark, d):
    """Gates on the baseline's precision and recall; closed unless every one passes."""
    m = prep.guesses(spark, d).agg((F.sum(F.col("ok").cast("long")) / F.count("guess")).alias("precision"), (F.sum(F.col("ok").cast("long")) / F.count(F.lit(1))).alias("recall"))
    return training.gates(m, [("precision", ">=", 0.6), ("recall", ">=", 0.9)]).withColumn("value", r6(F.col("value")))


@query(f"WITH {prep._GUESS}, s AS (SELECT profile, sum(ok::INT) / count(*) AS recall FROM gs GROUP BY profile) SELECT count(*) AS profiles, floor(avg(recall) * 1e6 + 0.5) / 1e6 AS macro_recall FROM s")
def macro_recall(spark, d):
    s = prep.guesses(spark, d).groupBy("profile").agg((F.sum(F.col("ok").cast("long")) / F.count(F.lit(1))).alias("recall"))
    return s.agg(F.count(F.lit(1)).alias("profiles"), r6(F.avg("recall")).alias("macro_recall"))


@query(f"WITH {prep._GUESS}, v AS (SELECT gram FROM u), n AS (SELECT source, target, count(*) AS pairs FROM gs GROUP BY ALL) SELECT relation, least(n.pairs, 5) AS pair_count, gs.source IN (SELECT gram FROM v) AS known, CAST(sum(ok::INT) AS BIGINT) AS tp, CAST(sum((guess IS NOT NULL AND NOT ok)::INT) AS BIGINT) AS fp FROM gs JOIN n ON n.source = gs.source AND n.target = gs.target GROUP BY ALL")
def emitted_buckets(spark, d):
    """True and false positives by relation, number of proven pairs and whether the word is known."""
    g = prep.guesses(spark, d)
    n = g.groupBy("source", "target").agg(F.count(F.lit(1)).alias("pairs"))
    known = language.model(spark, d)[0].select(F.col("gram").alias("source"), F.lit(True).alias("known"))
    j = g.join(n, ["source", "target"]).join(known, "source", "left").select("*", F.least("pairs", F.lit(5)).alias("pair_count"), F.coalesce("known", F.lit(False)).alias("is_known"))
    return j.groupBy("relation", "pair_count", F.col("is_known").alias("known")).agg(F.sum(F.col("ok").cast("long")).alias("tp"), F.sum((F.col("guess").isNotNull() & ~F.col("ok")).cast("long")).alias("fp"))


@query()
def osa_pairs(spark, d):
    """Alignment distance of each correction to its error; tested on cases."""
    return prep.pairs(spark, d).select(F.lower("error").alias("source"), F.lower("correction").alias("target")).distinct().withColumn("distance", osa_distance("source", "target"))
