"""Queries that score the given tables with models whose parameters follow a rule.

The vocabulary, its weights and the scales are fitted on the train rows as ever; weights, trees and
layers come from the rules below instead of a fit. So SQL can recompute every probability from the
tables, and with them verdicts, tuned cuts, metrics, counterfactual means and what a stream writes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from urlsieve.catalog import corpus as C
from urlsieve.catalog import relations as R
from urlsieve.catalog import sql as S
from urlsieve.constants import FEATURE_NAMES, MAX_FPR, SMOKE_URLS
from urlsieve.operators import models as M
from urlsieve.operators.boosting import Boosted
from urlsieve.operators.epochs import Fitted, Linear, Network, NetworkConfig
from urlsieve.operators.evaluate import eval_table, tune_threshold
from urlsieve.operators.split import augment_bare_domains, group_split
from urlsieve.plans.train import MODEL_SCORES, smoke_scores, smoke_verdicts
from urlsieve.session import materialize, scratch_path
from urlsieve.streaming.features import stream_scores, url_stream

TREES = 6
HIDDEN = 4
TAB = len(FEATURE_NAMES)


def weight(i: int) -> float:
    """Weight of the i-th gram."""
    return ((37 * i) % 101 - 50) / 20


def split_of(t: int, k: int) -> tuple[int, float]:
    """Feature and cut of inner node ``k`` (0 root, 1 left, 2 right) of tree ``t``."""
    return (7 * t + 11 * k + 3) % TAB, ((13 * t + 5 * k) % 9 - 4) / 4 + 0.0137


def gram_of(t: int) -> tuple[int, float]:
    """Gram (modulo the vocabulary) and cut of the root of the t-th hybrid tree."""
    return 131 * t + 17, 0.0123 * t


def leaf(t: int, j: int) -> float:
    return ((17 * t + 7 * j) % 11 - 5) / 10


def parameter(i: int) -> float:
    """The i-th weight or shift of the network; its layers' norms stay as they start."""
    return ((29 * i) % 83 - 41) / 60


def _tree(splits: list[tuple[int, float]], t: int) -> dict[str, np.ndarray]:
    """A full tree of depth 2: nodes 0, 1, 2 split, 3 to 6 are leaves."""
    return {
        "column": np.array([c for c, _ in splits] + [-1] * 4), "threshold": np.array([x for _, x in splits] + [0.0] * 4),
        "left": np.array([1, 3, 5, -1, -1, -1, -1]), "right": np.array([2, 4, 6, -1, -1, -1, -1]),
        "value": np.array([0.0] * 3 + [leaf(t, j) for j in range(4)]), "gain": np.ones(7), "rows": np.ones(7, int),
    }


def given_models(vec: M.Vectorizer) -> M.Models:
    def behind(split):
        return vec.size + split[0], split[1]

    trees = [_tree([split_of(t, k) for k in range(3)], t) for t in range(TREES)]
    mixed = [_tree([(gram_of(t)[0] % vec.size, gram_of(t)[1]), behind(split_of(t, 1)), behind(split_of(t, 2))], t + 1) for t in range(TREES)]
    cfg = NetworkConfig(hidden=HIDDEN)
    net = Network(TAB, cfg)
    i = 0
    for name, _ in net.shapes:
        if name.endswith((".w", ".b")):
            flat = net.p[name].reshape(-1)
            flat[:] = [parameter(i + k) for k in range(flat.size)]
            i += flat.size
    return M.Models(
        vec, Linear(np.array([weight(k) for k in range(vec.size)]), -0.3, []), Fitted(TAB, cfg, net.flat, []),
        Boosted(0.1, TAB, trees), Boosted(-0.2, vec.size + TAB, mixed),
    )


def splits(spark, sf):
    return materialize(augment_bare_domains(group_split(R.master_table(spark, sf))), "splits")


def given(spark, sf):
    """The split rows and the models over their train side."""
    data = splits(spark, sf)
    vec = M.fit_vectorizer(data.filter(F.col("split") == "train").select("url"), M.ModelConfig())
    return data, given_models(vec)


def _scored(spark, sf):
    data, models = given(spark, sf)
    rows = data.select("url", F.col("label").cast("int").alias("label"), "split")
    return materialize(M.score(rows, models), "given-scores"), models


PROBABILITIES = ["p_nlp", "p_nn", "p_tree", "p_hyb", "p_moe", "p_serving"]


def given_scores(spark, sf):
    """Every row with the probability of every expert and blend."""
    scored, _ = _scored(spark, sf)
    return scored.select("url", "label", "split", *[F.bround(p, 6).alias(p) for p in PROBABILITIES])


def _cut(scored):
    return tune_threshold(scored.filter("split = 'val'"), "label", "p_serving").first()["threshold"]


def given_evaluation(spark, sf):
    """Metrics of both held-out splits, the serving blend at the cut that the validation rows give."""
    scored, _ = _scored(spark, sf)
    cuts = {m: (c, _cut(scored) if m == "serving" else 0.5) for m, c in MODEL_SCORES.items()}
    tables = [eval_table(scored.filter(F.col("split") == s), "label", cuts).withColumn("split", F.lit(s)) for s in ("val", "test")]
    return tables[0].unionByName(tables[1])


def given_smoke(spark, sf):
    """The hand-labelled urls, scored and judged at the tuned cut."""
    scored, models = _scored(spark, sf)
    return smoke_verdicts(smoke_scores(spark, models), _cut(scored))


def given_counterfactual(spark, sf):
    _, models = given(spark, sf)
    pages = R.labelled_pages(spark, sf).select("url", F.col("label").alias("y")).distinct()
    return M.scheme_effect(pages, "y", models).select("variant", "y", "n", F.bround("mean_p", 6).alias("mean_p"))


def given_stream(spark, sf):
    """Every page through the scoring stream; the result is what the sink holds."""
    _, models = given(spark, sf)
    stream = url_stream(spark, sf, R.pages(spark, sf).schema, "pages.parquet").select("page_id", "url")
    root = scratch_path(spark, "stream")
    stream_scores(stream, models, f"{root}/sink", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/sink").select("page_id", "raw_url", "url", F.bround("p_serving", 6).alias("p_serving"))


def given_reload(spark, sf):
    """Scores by the models as they are read back from their files."""
    data, models = given(spark, sf)
    path = scratch_path(spark, "models")
    M.save_models(models, path, M.ModelConfig())
    scored = M.score(data.select("url", F.col("label").cast("int").alias("label"), "split"), M.load_models(spark, path))
    return scored.select("url", "label", "split", *[F.bround(p, 6).alias(p) for p in PROBABILITIES])


QUERIES = {
    "given_scores": given_scores,
    "given_evaluation": given_evaluation,
    "given_smoke": given_smoke,
    "given_counterfactual": given_counterfactual,
    "given_stream": given_stream,
    "given_reload": given_reload,
}


def _case(t: int, root: str, low: str, high: str, shift: int) -> str:
    """SQL of a tree of depth 2 over the conditions of its inner nodes."""
    a, b, c, d = (leaf(t + shift, j) for j in range(4))
    return f"CASE WHEN {root} THEN CASE WHEN {low} THEN {a} ELSE {b} END ELSE CASE WHEN {high} THEN {c} ELSE {d} END END::DOUBLE"


def _asks(t: int, k: int) -> str:
    column, cut = split_of(t, k)
    return f"x.{FEATURE_NAMES[column]} <= {cut!r}::DOUBLE"


def _network() -> list[tuple[str, str]]:
    """(relation, select list) of each layer, one relation after the other; ``h0`` has the scaled features."""
    taken = 0

    def layer(inputs: list[str], width: int) -> list[str]:
        nonlocal taken
        out = []
        for j in range(width):
            terms = [f"{parameter(taken + i * width + j)!r}::DOUBLE * {x}" for i, x in enumerate(inputs)]
            shift = parameter(taken + len(inputs) * width + j)
            out.append(f"({' + '.join(terms)} + {shift!r}::DOUBLE)")
        taken += (len(inputs) + 1) * width
        return out

    def bent(z: str) -> str:
        """Norm with a mean of 0 and a variance of 1, then x / (1 + exp(-x))."""
        a = f"({z} / sqrt(1 + 1e-5::DOUBLE))"
        return f"{a} / (1 + exp(-{a}))"

    def cells(name: str, width: int) -> list[str]:
        return [f"{name}.v{j}" for j in range(width)]

    steps = [("h1", [bent(z) for z in layer([f"x.{n}" for n in FEATURE_NAMES], HIDDEN)], "x")]
    source = "h1"
    for k in (1, 2):
        steps.append((f"i{k}", [bent(z) for z in layer(cells(source, HIDDEN), HIDDEN)], source))
        added = [f"{source}.v{j} + {bent(z)}" for j, z in enumerate(layer(cells(f"i{k}", HIDDEN), HIDDEN))]
        steps.append((f"r{k}", added, f"i{k} JOIN {source} USING (url)"))
        source = f"r{k}"
    steps.append(("md", [bent(z) for z in layer(cells(source, HIDDEN), HIDDEN // 2)], source))
    steps.append(("nn", layer(cells("md", HIDDEN // 2), 1), "md"))
    return [(name, f"SELECT url, {', '.join(f'{e} AS v{j}' for j, e in enumerate(found))} FROM {origin}") for name, found, origin in steps]


def scored_sql(target: str) -> str:
    """CTEs ``aug`` (the split rows) and ``sc``: the probabilities of every url of ``aug`` and of ``target``, a select of urls."""
    scaled = ", ".join(f"(ft.{n} - m_{n}) / CASE WHEN s_{n} = 0 THEN 1 ELSE s_{n} END AS {n}" for n in FEATURE_NAMES)
    stats = ", ".join(f"avg({n}::DOUBLE) AS m_{n}, stddev_pop({n}::DOUBLE) AS s_{n}" for n in FEATURE_NAMES)
    trees = " + ".join(_case(t, _asks(t, 0), _asks(t, 1), _asks(t, 2), 0) for t in range(TREES))
    mixed = " + ".join(_case(t, f"coalesce(g{t}, 0) <= {gram_of(t)[1]!r}::DOUBLE", _asks(t, 1), _asks(t, 2), 1) for t in range(TREES))
    grams = ", ".join(f"max(CASE WHEN idx = {gram_of(t)[0]} % n_grams THEN w END) AS g{t}" for t in range(TREES))
    split_rows = C.ORACLES["bare_domain_augment"].removeprefix(f"WITH {C.SPLIT}\n")
    layers = ",\n".join(f"{name} AS ({select})" for name, select in _network())
    return f"""{C.SPLIT},
aug AS (SELECT url, label::INT AS label, split FROM ({split_rows})),
allu AS (SELECT DISTINCT url FROM (SELECT url FROM aug UNION ALL {target})),
{S.features('allu')},
{S.grams('allu')},
top AS (SELECT gram, count(*) AS df FROM tf SEMI JOIN (SELECT url FROM aug WHERE split = 'train') USING (url)
  GROUP BY gram ORDER BY sum(tf) DESC, gram LIMIT {M.VOCABULARY_SIZE}),
vocab AS (SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS idx, count(*) OVER () AS n_grams,
  ln((1 + (SELECT count(*) FROM aug WHERE split = 'train')) * 1.0::DOUBLE / (1 + df)) + 1 AS idf FROM top),
raww AS (SELECT url, idx, n_grams, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (gram)),
tw AS (SELECT url, idx, n_grams, w / sqrt(sum(w * w) OVER (PARTITION BY url)) AS w FROM raww),
txt AS (SELECT url, sum(w * ((37 * idx) % 101 - 50) / 20.0::DOUBLE) AS z, {grams} FROM tw GROUP BY url),
st AS (SELECT {stats} FROM ft SEMI JOIN (SELECT url FROM aug WHERE split = 'train') USING (url)),
x AS (SELECT ft.url, {scaled} FROM ft, st),
{layers},
z AS (SELECT x.url, coalesce(txt.z, 0) - 0.3::DOUBLE AS nlp, nn.v0 AS nn, 0.1::DOUBLE + {trees} AS tree, -0.2::DOUBLE + {mixed} AS hyb
  FROM x JOIN nn ON nn.url = x.url LEFT JOIN txt ON txt.url = x.url),
px AS (SELECT url, {', '.join(f'1 / (1 + exp(-{e})) AS p_{e}' for e in ('nlp', 'nn', 'tree', 'hyb'))} FROM z),
sc AS (SELECT *, 0.50::DOUBLE * p_hyb + 0.30::DOUBLE * p_nn + 0.20::DOUBLE * p_nlp AS p_moe,
  0.45::DOUBLE * p_nlp + 0.55::DOUBLE * p_hyb AS p_serving FROM px)"""


_NONE = "SELECT url FROM aug"
_ROWS = f"""WITH {scored_sql(_NONE)}
SELECT url, label, split, {', '.join(f'round_even({p}, 6) AS {p}' for p in PROBABILITIES)} FROM aug JOIN sc USING (url)"""

#: cut: the lowest threshold of highest F1 under the ceiling on the validation rows, else 0.5
_CUT = f"""{S.GRID},
cells AS (SELECT step, t, label AS y, p_serving AS p FROM aug JOIN sc USING (url), grid WHERE split = 'val'),
cnt AS ({S.counts('cells', 't', 'step')}),
met AS (SELECT step, {S.METRIC_SELECT} FROM cnt),
cut AS (SELECT coalesce((SELECT round_even(threshold, 2) FROM met WHERE fpr <= {MAX_FPR} AND f1_score > 0 ORDER BY f1_score DESC, step LIMIT 1), 0.5::DOUBLE) AS t)"""

_SMOKE = ", ".join("('" + u.replace("'", "''") + f"', {y})" for u, y in SMOKE_URLS)
_SM = f"SELECT {S.norm('u')} AS url FROM (VALUES {_SMOKE}) v(u, y)"
_PAGES = f"SELECT {S.norm('url')} AS url FROM pages"


def _evaluation() -> str:
    rows = "\n  UNION ALL ".join(
        f"SELECT split || '|{m}' AS model, label AS y, {c} AS p, {'(SELECT t FROM cut)' if m == 'serving' else '0.5::DOUBLE'} AS c FROM aug JOIN sc USING (url) WHERE split <> 'train'"
        for m, c in MODEL_SCORES.items()
    )
    return f"""WITH {scored_sql(_NONE)},
{_CUT},
lng AS ({rows}),
{S.AUC},
cnt2 AS ({S.counts('lng', 'c', 'model')}),
met2 AS (SELECT model, {S.METRIC_SELECT} FROM cnt2)
SELECT split_part(model, '|', 2) AS model, split_part(model, '|', 1) AS split, met2.* EXCLUDE (model), roc_auc FROM met2 JOIN auc USING (model)"""


ORACLES = {
    "given_scores": _ROWS,
    "given_reload": _ROWS,
    "given_evaluation": _evaluation(),
    "given_smoke": f"""WITH {scored_sql(_SM)},
{_CUT}
SELECT u AS url, CASE WHEN y = 1 THEN 'MAL' ELSE 'BEN' END AS truth, round(p_serving, 3) AS p,
  CASE WHEN (p_serving >= cut.t) = (y = 1) THEN 'ok' ELSE 'MISS' END AS verdict
FROM (VALUES {_SMOKE}) v(u, y) JOIN sc ON sc.url = {S.norm('u')}, cut""",
    "given_counterfactual": f"""WITH {scored_sql(f"{_PAGES} UNION ALL SELECT 'https://' || url FROM ({_PAGES})")},
pg AS (SELECT DISTINCT {S.norm('url')} AS url, CASE WHEN regexp_matches(url, '{R.SPAM}') THEN 1 ELSE 0 END AS y FROM pages)
SELECT variant, y, count(*) AS n, round_even(avg(p_serving), 6) AS mean_p
FROM pg, (VALUES ('bare', ''), ('https', 'https://')) v(variant, scheme) JOIN sc ON sc.url = scheme || pg.url GROUP BY variant, y""",
    "given_stream": f"""WITH {scored_sql(_PAGES)}
SELECT page_id, pages.url AS raw_url, sc.url AS url, round_even(p_serving, 6) AS p_serving FROM pages JOIN sc ON sc.url = {S.norm('pages.url')}""",
}
