"""Registered queries: training, cross-validation, word vectors and networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxgrain.functions import text as tx
from voxgrain.operators import features as fe
from voxgrain.operators import labels as la
from voxgrain.operators import metrics as me
from voxgrain.operators import models as mo
from voxgrain.operators import network as nw
from voxgrain.operators import scoring as sc
from voxgrain.operators import skipgram as sg
from voxgrain.plans import inputs as ip
from voxgrain.plans import jobs
from voxgrain.plans import label_queries as lq
from voxgrain.plans import sql
from voxgrain.sources import files as fl

EMBEDDING_SIZE, EMBEDDING_CLASSES = 64, 10
FULL_SIZES = (EMBEDDING_SIZE, *mo.HIDDEN_LAYERS, EMBEDDING_CLASSES)
NET_SIZES, NET_HELD, NET_EPOCHS, NET_RATE, NET_PATIENCE = (4, 5, 4, 3), 5, 40, 0.05, 6
RUN_AT = "2024-01-31T00:00:00"
# Fits end at the optimum, which the SQL finds in its own way, so that all digits shown agree.
EXACTLY = 1e-12


def _fit(spark, sf_dir):
    df = ip.labelled_documents(spark, sf_dir)
    return df, mo.fit_baseline(df, "text", tolerance=EXACTLY)


def ovr_logreg_predict(spark, sf_dir):
    df, model = _fit(spark, sf_dir)
    return ip.rounded(mo.baseline_scores(model, df).drop("text"))


def _fold_scores(spark, sf_dir):
    return mo.cross_validate(ip.labelled_documents(spark, sf_dir), "id", "text", tolerance=EXACTLY)


def ovr_cv_scores(spark, sf_dir):
    return ip.rounded(_fold_scores(spark, sf_dir))


def top_features(spark, sf_dir):
    _, model = _fit(spark, sf_dir)
    return ip.rounded(mo.top_features(mo.coefficients(spark, model)))


def model_roundtrip(spark, sf_dir):
    """What a saved and loaded model predicts."""
    df, model = _fit(spark, sf_dir)
    path = fl.scratch_folder(spark, "model")
    mo.save_model(model, path)
    return ip.rounded(mo.baseline_scores(mo.load_model(path), df).select("id", "predicted_sentiment", "confidence"))


def training_report(spark, sf_dir):
    """The report of a run, one row per metric."""
    df, model = _fit(spark, sf_dir)
    scores = fl.materialize(_fold_scores(spark, sf_dir))
    report = mo.training_report(df, "sentiment", scores, mo.top_features(mo.coefficients(spark, model), 10), RUN_AT)
    return ip.rounded(report.select("timestamp", "model_type", "samples", F.size("top_features").alias("features"), F.inline("metrics")))


def metrics_files(spark, sf_dir):
    """Metrics written as a JSON record of the run, then read back from the results folder."""
    summary = me.score_summary(lq._judged(spark, sf_dir), "sentiment", "predicted")
    folder = fl.scratch_folder(spark, "results")
    settings = {"good_words": ",".join(ip.GOOD_WORDS), "bad_words": ",".join(ip.BAD_WORDS)}
    fl.write_posts(fl.run_metadata(spark, summary, settings, RUN_AT, "weak_labels"), fl.run_path(folder, "metrics", "1"), "json")
    return ip.rounded(fl.read_metrics(spark, folder).drop("file"))


def word_pairs(spark, sf_dir):
    """Per word: other words near it, and their weight."""
    df = ip.documents(spark, sf_dir).select(tx.clean_text("text").alias("text"))
    return ip.rounded(sg.word_pairs(df, "text").groupBy("word").agg(F.count(F.lit(1)).alias("contexts"), F.sum("weight").alias("weight")), 4)


def word_vectors(spark, sf_dir):
    """Length of each trained word vector, and whether all its numbers are finite."""
    df = ip.documents(spark, sf_dir).select(tx.clean_text("text").alias("text"))
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6))
    return sg.train_vectors(df, "text").select("word", F.size("vector").alias("size"), finite.alias("finite"))


def _word_texts(spark, sf_dir):
    """Given vectors as words w0, w1, ... and texts that name known and unknown ones."""
    given = ip.table(spark, sf_dir, "embeddings")
    vectors = given.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vector"))
    name = lambda number: F.concat(F.lit("w"), number.cast("string"))
    vec = F.col("vec_id")
    texts = given.select("vec_id", F.concat_ws(" ", name(vec), name(vec + 1), name(vec % 7), F.lit("unknown")).alias("text"))
    return texts, vectors


def sentence_vectors(spark, sf_dir):
    texts, vectors = _word_texts(spark, sf_dir)
    found = sc.sentence_vectors(texts, "text", "vec_id", vectors, EMBEDDING_SIZE)
    total = lambda f: F.round(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + f(x.cast("double"))), 2)
    return found.select(
        "vec_id", F.size("vector").alias("size"), total(lambda x: x).alias("total"), total(lambda x: x * x).alias("square")
    )


def _embedded(spark, sf_dir):
    df = ip.table(spark, sf_dir, "embeddings")
    return df.select("vec_id", mo.as_vector("embedding").alias("features"), F.col("label").cast("double").alias("code"))


def _network(df):
    return mo.fit_network(df, "features", "code", EMBEDDING_SIZE, EMBEDDING_CLASSES)


def mlp_predict(spark, sf_dir):
    df = _embedded(spark, sf_dir)
    scored = mo.network_probabilities(_network(df), df)
    best = F.array_max("probabilities")
    return scored.select(
        "vec_id", (F.array_position("probabilities", best) - 1).alias("predicted"), F.round(best, 4).alias("confidence")
    )


def mlp_history(spark, sf_dir):
    """Loss and accuracy on both parts of a stratified split after each training round."""
    df = _embedded(spark, sf_dir)
    split = la.stratified_split(df, "code", "vec_id")
    _, history = mo.train_with_history(
        split.where(~F.col("is_validation")), split.where("is_validation"), "features", "code",
        EMBEDDING_SIZE, outputs=EMBEDDING_CLASSES,
    )
    return ip.rounded(history, 4)


def network_training(spark, sf_dir):
    """Every epoch of a network from given first weights: losses, accuracies, rate, and whether it was the best so far."""
    df = ip.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", 1, NET_SIZES[0]).alias("features"), (F.col("label") % NET_SIZES[-1]).alias("code")
    )
    held = F.col("vec_id") % NET_HELD == 0
    _, history = nw.train_network(
        df.where(~held), df.where(held), "features", "code", "vec_id", NET_SIZES[-1], NET_SIZES[0], NET_SIZES[1:-1], epochs=NET_EPOCHS,
        batches=1, rate=NET_RATE, dropout=0.0, patience=NET_PATIENCE, start=nw.unflat(_given_weights(NET_SIZES), NET_SIZES),
    )
    return ip.rounded(history)


def network_dropout(spark, sf_dir):
    """The whole network at its own settings: every vector's class by the weights of the lowest validation loss."""
    df = ip.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.col("label").alias("code"))
    split = la.stratified_split(df, "code", "vec_id")
    network, _ = nw.train_network(
        split.where(~F.col("is_validation")), split.where("is_validation"), "features", "code", "vec_id", EMBEDDING_CLASSES, EMBEDDING_SIZE, batches=1,
    )
    scored = df.withColumn("_chances", sc.forward_pass("features", network.layers))
    best = F.array_max("_chances")
    return scored.select("vec_id", (F.array_position("_chances", best) - 1).alias("predicted"), F.round(best, 4).alias("confidence"))


def mlp_objective(spark, sf_dir):
    return ip.rounded(mo.objective_history(spark, _network(_embedded(spark, sf_dir))), 4)


def _given_weights(sizes):
    """First weights by rule, the same in SQL."""
    number = np.arange(sum(m * n + n for m, n in zip(sizes, sizes[1:])))
    return (number * 37 + 11) % 101 / 101.0 - 0.5


def mlp_imported_weights(spark, sf_dir):
    """Class and probability of every vector by a network whose given weights were saved and loaded."""
    path = fl.scratch_folder(spark, "network")
    nw.save_network(spark, nw.Network(nw.unflat(_given_weights(FULL_SIZES), FULL_SIZES)), path)
    network = nw.load_network(spark, path)
    df = ip.table(spark, sf_dir, "embeddings").withColumn("_chances", sc.forward_pass("embedding", network.layers))
    best = F.array_max("_chances")
    return df.select("vec_id", (F.array_position("_chances", best) - 1).alias("predicted"), F.round(best, 6).alias("confidence"))


def network_sentiment(spark, sf_dir):
    """Texts to word vectors to sentence vectors to a network: the five prediction columns."""
    df = ip.labelled_documents(spark, sf_dir)
    folder = fl.scratch_folder(spark, "network")
    jobs.train_network(df, folder, "text")
    return ip.rounded(jobs.network_scores(df.select("id", "text"), folder, "text").drop("text"), 4)


QUERIES = {
    f.__name__: f
    for f in (
        ovr_logreg_predict, ovr_cv_scores, top_features, model_roundtrip,
        training_report, metrics_files, word_pairs, word_vectors, sentence_vectors, mlp_predict, mlp_history, mlp_objective,
        mlp_imported_weights, network_training, network_dropout, network_sentiment,
    )
}

_F1 = lambda c: (
    f"2.0::DOUBLE * count(*) FILTER (sentiment = '{c}' AND predicted = '{c}') "
    f"/ (count(*) FILTER (sentiment = '{c}') + count(*) FILTER (predicted = '{c}'))"
)

# The baseline once more: what a gradient method in the space of the training rows converges to. The
# weights are a sum of rows, a is how much of each; rows meet through their inner products (gram).
# held is the fold a model does not see, -1 where it sees all rows.
FIT_STEPS = 500
_MODELS = {
    "held": "SELECT h FROM (VALUES {held}) AS v(h)",
    "parts": f"""SELECT id, sentiment, CAST((row_number() OVER (PARTITION BY sentiment ORDER BY {sql.draw('id')}, id) - 1) % {mo.FOLDS} AS INTEGER) AS fold
        FROM labelled""",
    "seen": "SELECT h, id, sentiment FROM held, parts WHERE fold <> h",
    "counted": "SELECT h, term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM seen JOIN terms USING (id) GROUP BY h, term",
    "kept": f"""SELECT h, term, ln((n + 1.0::DOUBLE) / (documents + 1.0::DOUBLE)) + 1.0 AS idf
        FROM counted JOIN (SELECT h, count(*) AS n FROM seen GROUP BY h) USING (h)
        WHERE documents >= {fe.MIN_DOCUMENTS} AND documents <= n * {fe.MAX_DOCUMENT_SHARE}
        QUALIFY row_number() OVER (PARTITION BY h ORDER BY occurrences DESC, term) <= {fe.MAX_FEATURES}""",
    "weighed": "SELECT h, id, term, count(*) * any_value(idf) AS x FROM terms JOIN kept USING (term) GROUP BY h, id, term",
    "features": """SELECT h, id, term, x / sqrt(norm) AS x FROM weighed JOIN (SELECT h, id, sum(x * x) AS norm FROM weighed GROUP BY h, id) USING (h, id)
        UNION ALL SELECT h, id, '', 1.0 FROM held, labelled""",
    "gram": """SELECT a.h, a.id AS i, b.id AS j, sum(a.x * b.x) AS k FROM features a JOIN features b ON a.h = b.h AND a.term = b.term
        JOIN seen s ON s.h = b.h AND s.id = b.id GROUP BY a.h, a.id, b.id""",
    "products": "SELECT h, i, list(k ORDER BY j) AS r FROM gram GROUP BY h, i",
    "matrix": "SELECT p.h, list(r ORDER BY i) AS m, 1 + max(list_sum(r)) / 4 AS bound FROM products p JOIN seen s ON s.h = p.h AND s.id = p.i GROUP BY p.h",
    "targets": f"""SELECT h, class, list((sentiment = class)::INTEGER::DOUBLE ORDER BY id) AS y
        FROM seen, (VALUES {', '.join(f"('{c}')" for c in la.CLASSES)}) AS c(class) GROUP BY h, class""",
    "fit": f"""SELECT 0 AS step, h, class, y, list_transform(y, lambda q: 0.0::DOUBLE) AS a, list_transform(y, lambda q: 0.0::DOUBLE) AS v FROM targets
        UNION ALL SELECT step + 1, h, class, y, b,
          list_transform(list_zip(b, a), lambda z: z[1] + (sqrt(bound) - 1) / (sqrt(bound) + 1) * (z[1] - z[2]))
        FROM (SELECT step, f.h, class, y, a, bound,
            list_transform(list_zip(v, y, m), lambda z: z[1] - (z[1] + 1 / (1 + exp(-list_dot_product(z[3], v))) - z[2]) / bound) AS b
          FROM fit f JOIN matrix m ON m.h = f.h WHERE step < {FIT_STEPS})""",
    "done": f"SELECT h, class, a FROM fit WHERE step = {FIT_STEPS}",
    "chances": "SELECT h, i AS id, class, 1 / (1 + exp(-list_dot_product(r, a))) AS p FROM products JOIN done USING (h)",
    "spread": "SELECT h, id, " + ", ".join(f"sum(p) FILTER (class = '{c}') / sum(p) AS prob_{c}" for c in la.CLASSES) + " FROM chances GROUP BY h, id",
    "predicted": "SELECT *, greatest(" + ", ".join(f"prob_{c}" for c in la.CLASSES) + ") AS confidence, CASE "
        + " ".join(f"WHEN prob_{c} = confidence THEN '{c}'" for c in la.CLASSES) + " END AS predicted_sentiment FROM spread JOIN parts USING (id)",
}
_COEFFICIENTS = """SELECT class AS sentiment, term, sum(x * list_extract(a, place)) AS coefficient
    FROM features JOIN (SELECT h, id, row_number() OVER (PARTITION BY h ORDER BY id) AS place FROM seen) USING (h, id) JOIN done USING (h)
    WHERE term <> '' GROUP BY class, term"""
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY round(coefficient, {mo.TIE_DIGITS}) DESC, term) AS first,
    row_number() OVER (PARTITION BY sentiment ORDER BY round(coefficient, {mo.TIE_DIGITS}), term) AS last FROM coefficients"""
_OVER = lambda part, whole: f"CASE WHEN {whole} = 0 THEN 0 ELSE ({part})::DOUBLE / {whole} END"
_SCORES = f"""SELECT fold, sum(hits) / sum(support) AS accuracy, avg({_OVER('2 * hits', '(support + claimed)')}) AS f1_macro,
    avg({_OVER('hits', 'claimed')}) AS precision_macro, avg({_OVER('hits', 'support')}) AS recall_macro FROM (
      SELECT fold, class, count(*) FILTER (sentiment = class AND predicted_sentiment = class) AS hits, count(*) FILTER (sentiment = class) AS support,
        count(*) FILTER (predicted_sentiment = class) AS claimed
      FROM predicted, (VALUES {', '.join(f"('{c}')" for c in la.CLASSES)}) AS c(class) WHERE fold = h GROUP BY fold, class)
    WHERE support + claimed > 0 GROUP BY fold"""


def _with_models(query, held="(-1)", **more):
    named = {**dict(labelled=sql.LABELLED, words=lq._WORDS, terms=lq._TERMS), **_MODELS, **more}
    named["held"] = named["held"].format(held=held)
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({body})" if name == "fit" else f"{name} AS MATERIALIZED ({body})" for name, body in named.items()) + "\n" + query


_FOLDS = ", ".join(f"({f})" for f in range(mo.FOLDS))
_METRICS = ("f1_macro", "accuracy", "precision_macro", "recall_macro")


# A network in SQL: lists of units; weights are one list, per layer each unit's weights and then the biases.
_SPANS = lambda sizes: [(sum(m * n + n for m, n in list(zip(sizes, sizes[1:]))[:i]), m, n) for i, (m, n) in enumerate(zip(sizes, sizes[1:]))]
_GIVEN = lambda sizes: f"list_transform(range({_given_weights(sizes).size}), lambda i: ((i * 37 + 11) % 101) / 101.0::DOUBLE - 0.5::DOUBLE)"
_POWERS = lambda z: f"list_transform({z}, lambda q: exp(q - list_max({z})))"
_SHARES = lambda e: f"list_transform({e}, lambda q: q / list_sum({e}))"


def _layer(span, x, last=False):
    at, m, n = span
    unit = f"list_dot_product(w[{at} + j * {m} + 1:{at} + j * {m} + {m}], {x}) + w[{at + m * n} + j + 1]"
    return f"list_transform(range({n}), lambda j: {unit if last else f'greatest(0.0::DOUBLE, {unit})'})"


def _forward(source, sizes):
    """Rows of ``source`` (w, x) with the layers h0, h1, ... and the probabilities p."""
    spans, query = _SPANS(sizes), f"SELECT *, x AS h0 FROM ({source})"
    for i, span in enumerate(spans):
        last = i == len(spans) - 1
        query = f"SELECT *, {_layer(span, f'h{i}', last)} AS {'z' if last else f'h{i + 1}'} FROM ({query})"
    return f"SELECT *, {_SHARES('e')} AS p FROM (SELECT *, {_POWERS('z')} AS e FROM ({query}))"


def _backward(source, sizes):
    """Rows of ``source`` (h0, ..., p, code) with loss, hit and the gradient g."""
    spans = _SPANS(sizes)
    query = f"SELECT * EXCLUDE (e), {_POWERS('p')} AS e FROM ({source})"
    query = f"SELECT *, {_SHARES('e')} AS s, (list_position(p, list_max(p)) - 1 = code)::INTEGER AS hit FROM ({query})"
    query = f"SELECT *, -ln(s[code + 1]) AS loss, list_transform(range({sizes[-1]}), lambda k: s[k + 1] - (k = code)::INTEGER) AS t FROM ({query})"
    query = f"SELECT *, list_transform(list_zip(p, t), lambda q: q[1] * (q[2] - list_dot_product(p, t))) AS d{len(spans)} FROM ({query})"
    for i in reversed(range(1, len(spans))):
        at, m, n = spans[i]
        down = f"list_transform(range({m}), lambda a: CASE WHEN h{i}[a + 1] > 0 THEN list_sum(list_transform(range({n}), lambda k: w[{at} + k * {m} + a + 1] * d{i + 1}[k + 1])) ELSE 0 END)"
        query = f"SELECT *, {down} AS d{i} FROM ({query})"
    parts = [f"flatten(list_transform(d{i + 1}, lambda q: list_transform(h{i}, lambda r: q * r))) || d{i + 1}" for i in range(len(spans))]
    return f"SELECT *, {' || '.join(parts)} AS g FROM ({query})"


_STATE = "epoch, m, v, rate, base, bad, lowest, waited"
_KEEP = ", ".join(f"any_value({c}) AS {c}" for c in (*_STATE.split(", "), "w"))


def _training(sizes):
    size = _given_weights(sizes).size
    zeros, (one, two) = f"list_transform(range({size}), lambda i: 0.0::DOUBLE)", nw.MOMENTS
    start = f"""SELECT 0 AS epoch, {_GIVEN(sizes)} AS w, {zeros} AS m, {zeros} AS v, {NET_RATE}::DOUBLE AS rate, 'Infinity'::DOUBLE AS base, 0 AS bad,
        'Infinity'::DOUBLE AS lowest, 0 AS waited, 0.0::DOUBLE AS train_loss, 0.0::DOUBLE AS train_accuracy, 0.0::DOUBLE AS val_loss,
        0.0::DOUBLE AS val_accuracy, {NET_RATE}::DOUBLE AS used, FALSE AS best"""
    source = f"SELECT {_STATE}, w, x, code FROM fit, data WHERE NOT held AND epoch < {NET_EPOCHS} AND waited < {NET_PATIENCE}"
    query = f"SELECT {_KEEP}, avg(loss) AS train_loss, avg(hit) AS train_accuracy, list(g) AS gs FROM ({_backward(_forward(source, sizes), sizes)}) HAVING count(*) > 0"
    query = f"SELECT *, list_transform(range({size}), lambda i: list_sum(list_transform(gs, lambda q: q[i + 1])) / len(gs)) AS slope FROM ({query})"
    query = f"""SELECT * EXCLUDE (gs, slope, m, v), list_transform(list_zip(m, slope), lambda q: {one} * q[1] + (1 - {one}) * q[2]) AS m,
        list_transform(list_zip(v, slope), lambda q: {two} * q[1] + (1 - {two}) * q[2] * q[2]) AS v FROM ({query})"""
    query = f"""SELECT * EXCLUDE (w), list_transform(list_zip(w, m, v), lambda q: q[1] - rate * (q[2] / (1 - {one} ** (epoch + 1)))
        / (sqrt(q[3] / (1 - {two} ** (epoch + 1))) + {nw.EPSILON})) AS w FROM ({query})"""
    query = _forward(f"SELECT q.*, x, code FROM ({query}) q, data WHERE held", sizes)
    query = f"SELECT * EXCLUDE (e), {_POWERS('p')} AS e FROM ({query})"
    query = f"""SELECT {_KEEP}, any_value(train_loss) AS train_loss, any_value(train_accuracy) AS train_accuracy, avg(-ln(e[code + 1] / list_sum(e))) AS val_loss,
        avg((list_position(p, list_max(p)) - 1 = code)::INTEGER) AS val_accuracy FROM ({query}) HAVING count(*) > 0"""
    better = f"val_loss < base * (1 - {nw.RATE_THRESHOLD})"
    return f"""{start} UNION ALL SELECT epoch + 1, w, m, v, CASE WHEN NOT {better} AND bad + 1 > {nw.RATE_PATIENCE} THEN rate * {nw.RATE_FACTOR} ELSE rate END,
        CASE WHEN {better} THEN val_loss ELSE base END, CASE WHEN {better} OR bad + 1 > {nw.RATE_PATIENCE} THEN 0 ELSE bad + 1 END,
        least(lowest, val_loss), CASE WHEN val_loss < lowest THEN 0 ELSE waited + 1 END, train_loss, train_accuracy, val_loss, val_accuracy, rate, val_loss < lowest
        FROM ({query})"""


_VECTORS = f"""SELECT vec_id % {NET_HELD} = 0 AS held, list_transform(embedding[1:{NET_SIZES[0]}], lambda q: q::DOUBLE) AS x, label % {NET_SIZES[-1]} AS code
    FROM embeddings"""


def _passed(sizes):
    """One row per vector with its probabilities; a layer is a join of its inputs with the units' weights."""
    named = {
        "weights": f"SELECT i, ((i * 37 + 11) % 101) / 101.0::DOUBLE - 0.5::DOUBLE AS w FROM range({_given_weights(sizes).size}) AS t(i)",
        "h0": "SELECT vec_id, list_transform(embedding, lambda q: q::DOUBLE) AS h FROM embeddings",
    }
    for number, (at, m, n) in enumerate(_SPANS(sizes), 1):
        named[f"u{number}"] = f"""SELECT (i - {at}) // {m} AS unit, list(w ORDER BY i) AS w FROM weights WHERE i >= {at} AND i < {at + m * n} GROUP BY unit"""
        value = "list_dot_product(u.w, h) + b.w"
        named[f"h{number}"] = f"""SELECT vec_id, list({value if number == len(sizes) - 1 else f'greatest(0.0::DOUBLE, {value})'} ORDER BY unit) AS h
            FROM h{number - 1}, u{number} u JOIN weights b ON b.i = {at + m * n} + unit GROUP BY vec_id"""
    query = f"SELECT vec_id, {_SHARES('e')} AS p FROM (SELECT vec_id, {_POWERS('h')} AS e FROM h{len(sizes) - 1})"
    return sql.with_named(f"SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS predicted, round(list_max(p), 6) AS confidence FROM ({query})", **named)


_LINES = f"SELECT list_filter(string_split({sql.cleaned('text')}, ' '), lambda q: q <> '') AS w FROM documents"

SQL = {
    "network_training": f"""WITH RECURSIVE data AS MATERIALIZED ({_VECTORS}), fit AS ({_training(NET_SIZES)})
        SELECT epoch, round(train_loss, 6) AS train_loss, round(train_accuracy, 6) AS train_accuracy, round(val_loss, 6) AS val_loss,
        round(val_accuracy, 6) AS val_accuracy, round(used, 6) AS rate, best FROM fit WHERE epoch > 0""",
    "ovr_logreg_predict": _with_models(
        "SELECT id, sentiment, predicted_sentiment, round(confidence, 6) AS confidence, "
        + ", ".join(f"round(prob_{c}, 6) AS prob_{c}" for c in la.CLASSES) + " FROM predicted"
    ),
    "model_roundtrip": _with_models("SELECT id, predicted_sentiment, round(confidence, 6) AS confidence FROM predicted"),
    "ovr_cv_scores": _with_models(
        "SELECT fold, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS) + " FROM scores", _FOLDS, scores=_SCORES
    ),
    "top_features": _with_models(
        " UNION ALL ".join(
            f"SELECT sentiment, '{d}' AS direction, CAST({place} AS INTEGER) AS place, term, round(coefficient, 6) AS coefficient FROM ranked WHERE {place} <= {mo.TOP_FEATURES}"
            for d, place in (("positive", "first"), ("negative", "last"))
        ),
        coefficients=_COEFFICIENTS, ranked=_RANKED,
    ),
    "training_report": _with_models(
        " UNION ALL ".join(
            f"""SELECT '{RUN_AT}' AS timestamp, 'tfidf_logistic_baseline' AS model_type, (SELECT count(*) FROM labelled) AS samples,
            30 AS features, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM scores"""
            for m in _METRICS
        ),
        _FOLDS, scores=_SCORES,
    ),
    "metrics_files": sql.with_named(
        f"""SELECT 'weak_labels' AS model_type, round(count(*) FILTER (sentiment = predicted) / count(*)::DOUBLE, 6) AS accuracy,
        round(({' + '.join(_F1(c) for c in la.CLASSES)}) / 3, 6) AS f1_macro FROM judged""",
        keys=lq._KEYS, judged=lq._JUDGED,
    ),
    "sentence_vectors": f"""
        WITH v AS (SELECT 'w' || vec_id AS word, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        u AS (SELECT word, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
        t AS (SELECT vec_id, unnest(['w' || vec_id, 'w' || (vec_id + 1), 'w' || (vec_id % 7)]) AS word FROM v),
        d AS (SELECT vec_id, place, avg(x) AS x FROM (SELECT vec_id, unnest(e) AS x, unnest(range({EMBEDDING_SIZE})) AS place
            FROM t JOIN u ON u.word = t.word) GROUP BY vec_id, place)
        SELECT vec_id, CAST(count(*) AS INTEGER) AS size, round(sum(x), 2) AS total, round(sum(x * x), 2) AS square FROM d GROUP BY vec_id""",
    "mlp_imported_weights": _passed(FULL_SIZES),
    "word_pairs": sql.with_named(
        f"SELECT a AS word, count(*) AS contexts, round(sum(steps) / {sg.WINDOW}.0::DOUBLE, 4) AS weight FROM pairs GROUP BY a",
        lines=_LINES, near=" UNION ALL ".join(f"SELECT w[i] AS a, w[i + {d}] AS b, {sg.WINDOW - d + 1} AS steps FROM (SELECT w, unnest(range(1, len(w) - {d} + 1)) AS i FROM lines WHERE len(w) > {d})" for d in range(1, sg.WINDOW + 1)),
        pairs="SELECT a, b, sum(steps) AS steps FROM (SELECT a, b, steps FROM near UNION ALL SELECT b, a, steps FROM near) GROUP BY a, b",
    ),
    "word_vectors": f"""SELECT word, {sg.SIZE} AS size, TRUE AS finite FROM (SELECT unnest(w) AS word FROM ({_LINES})) GROUP BY word HAVING count(*) >= {sg.MIN_COUNT}""",
}
