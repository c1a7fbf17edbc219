"""The queries of ``queries.py`` in SQL, written independently of the Spark code.

``VIEWS`` are the shared inputs; each oracle is a query over them and the test tables.
"""

from __future__ import annotations

from raterkit.models.runs import MODELS
from raterkit.plans.views import FLAGS

ORDER = "l_orderkey, l_linenumber, l_suppkey, rating"


def hashed(text: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 15) AS UBIGINT) AS BIGINT)"


def sid(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def share(value: str, name: str) -> str:
    hit = f"CASE WHEN o_orderpriority = '{value}' OR o_orderstatus = '{value}' THEN 1.0 ELSE 0.0 END"
    return f"avg(CAST({hit} AS DOUBLE)) > 0.3 AS {name}"


def yes_no(column: str, name: str) -> str:
    return f"CASE WHEN {column} THEN 'Yes' WHEN NOT {column} THEN 'No' END AS {name}"


VIEWS = {
    "fx_ratings": """
SELECT l_partkey AS comment_id, o_custkey AS annotator_id,
       CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS rating,
       l_orderkey, l_linenumber, l_suppkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_nulls": """
SELECT comment_id, CASE WHEN annotator_id % 97 <> 0 THEN annotator_id END AS annotator_id,
       CASE WHEN (l_orderkey + l_suppkey) % 13 <> 0 THEN rating END AS rating,
       l_orderkey, l_linenumber, l_suppkey
FROM fx_ratings""",
    "fx_unique": f"""
SELECT comment_id, annotator_id, rating, CASE WHEN rating <> 0 THEN 1 ELSE 0 END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY annotator_id, comment_id ORDER BY {ORDER}) AS rn FROM fx_ratings) z
WHERE rn = 1""",
    "fx_split": f"""
SELECT comment_id, CASE WHEN {hashed(sid('comment_id') + " || ':36'")} < {int(0.3 * (1 << 60))} THEN 'test' ELSE 'train' END AS part
FROM (SELECT DISTINCT comment_id FROM fx_ratings) c""",
    "fx_scores": f"""
SELECT comment_id, annotator_id, label,
       round(({hashed(sid('comment_id') + " || '/' || " + sid('annotator_id'))} % 100 + 20 * label)
             / CAST(120 AS DOUBLE), 6) AS prob
FROM fx_unique JOIN fx_split USING (comment_id) WHERE part = 'test'""",
    "fx_model_scores": f"""
SELECT comment_id, annotator_id, label, model,
       round(({hashed("model || '/' || " + sid('comment_id') + " || '/' || " + sid('annotator_id'))} % 100
              + length(model) * label) / CAST(125 AS DOUBLE), 6) AS prob
FROM fx_scores, (SELECT unnest({MODELS}) AS model) m""",
    "fx_people": f"""
SELECT c_custkey AS annotator_id, c_mktsegment AS annotator_gender,
       CASE WHEN c_custkey % 20 = 0 THEN TRUE WHEN c_custkey % 7 <> 0 THEN FALSE END AS annotator_transgender,
       CASE WHEN c_custkey % 11 <> 0 THEN CAST(18 + c_custkey % 60 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS annotator_age,
       n_name AS annotator_educ,
       CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN 'up_to_3000'
            WHEN c_acctbal < 6000 THEN 'up_to_6000' ELSE 'over_6000' END AS annotator_income,
       r_name AS annotator_ideology, {', '.join(FLAGS)}
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, {', '.join(share(v, n) for n, v in FLAGS.items())} FROM orders GROUP BY o_custkey) o
       ON o_custkey = c_custkey""",
    "fx_raters": f"""
SELECT annotator_id, annotator_gender AS gender, {yes_no('annotator_transgender', 'identify_as_transgender')},
       annotator_educ AS education, annotator_income AS age_range,
       {yes_no('annotator_sexuality_gay', 'lgbtq_status')}, annotator_ideology AS political_affilation,
       {yes_no('annotator_gender_women', 'is_parent')},
       {yes_no('annotator_religion_buddhist', 'religion_important')},
       NULLIF(concat_ws(',', CASE WHEN annotator_race_asian THEN 'Asian' END,
                        CASE WHEN annotator_race_native_american THEN ' Native' END,
                        CASE WHEN annotator_gender_men THEN 'White' END), '') AS race
FROM fx_people""",
    "fx_texts": """
SELECT p_partkey AS comment_id, embedding FROM part
JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)""",
    "fx_raters_vec": """
SELECT c_custkey AS annotator_id, vec_id, embedding FROM customer
JOIN embeddings ON vec_id = c_custkey % (SELECT count(*) FROM embeddings)""",
    "fx_cells": """
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
FROM embeddings""",
    "fx_nested": f"""
SELECT n.*, 'comment ' || {sid('comment_id')} AS comment, CAST(floor(spot / 256) AS BIGINT) AS line
FROM (SELECT *, row_number() OVER (ORDER BY comment_id, {ORDER}) - 1 AS spot FROM fx_ratings) n""",
}


def batches(source: str, batch_rows: int = 512) -> str:
    """Rows of ``source`` with their batch, by the documented seeded order."""
    by_comment = hashed(sid("comment_id") + " || ':0'")
    by_rater = hashed(sid("comment_id") + " || ':0/' || " + sid("annotator_id"))
    order = f"{by_comment}, comment_id, {by_rater}, annotator_id"
    return f"SELECT *, CAST(floor((row_number() OVER (ORDER BY {order}) - 1) / {batch_rows}) AS BIGINT) AS batch_id FROM {source}"


def frequent(source: str, key: str, floor: int) -> str:
    return f"SELECT * FROM {source} WHERE {key} IN (SELECT {key} FROM {source} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) >= {floor})"


def first(source: str, keys: str, order: str) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1"


def vector_checks(keys: str, source: str, vector: str) -> str:
    """Width, sum and position-weighted sum of a vector column."""
    return f"""
SELECT {keys}, CAST(len(v) AS BIGINT) AS width, round(list_sum(v), 6) AS total,
       round(list_dot_product(v, CAST(range(1, len(v) + 1) AS DOUBLE[])), 6) AS by_position
FROM (SELECT {keys}, CAST({vector} AS DOUBLE[]) AS v FROM {source})"""


BCE = "greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))"
LOGITS = "(SELECT *, 4 * prob - 2 AS z FROM fx_scores)"


def counts(source: str, by: str, said: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""
SELECT {lead}coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r,
       coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f
FROM (SELECT {lead}CAST(sum(CASE WHEN label = 1 AND {said} THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
             CAST(sum(CASE WHEN label = 0 AND {said} THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
             CAST(sum(CASE WHEN label = 1 AND NOT ({said}) THEN 1 ELSE 0 END) AS DOUBLE) AS fn
      FROM {source} {group})"""


def auc(source: str, by: str) -> str:
    return f"""
SELECT {by}, CAST(sum(np * (below + nn / 2.0)) AS DOUBLE) / nullif(CAST(sum(np) AS DOUBLE) * CAST(sum(nn) AS DOUBLE), 0) AS auc
FROM (SELECT *, coalesce(sum(nn) OVER (PARTITION BY {by} ORDER BY prob
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {by}, prob, sum(label) AS np, sum(1 - label) AS nn FROM {source} GROUP BY {by}, prob))
GROUP BY {by}"""


def evaluated(source: str) -> str:
    return f"""
SELECT model, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(auc, 6) AS auc
FROM ({counts(source, 'model', 'prob > 0.5')}) JOIN ({auc(source, 'model')}) USING (model)"""


def long_features(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT annotator_id, '{c}_' || {c} AS feature FROM fx_raters WHERE {c} IS NOT NULL" for c in columns
    )


RACES = """
SELECT DISTINCT annotator_id, 'race_' || item AS feature
FROM (SELECT annotator_id, unnest(string_split(race, ',')) AS item FROM fx_raters) WHERE item <> ''"""

BLOCKS = [
    "gender",
    "identify_as_transgender",
    "education",
    "age_range",
    "lgbtq_status",
    "political_affilation",
    "is_parent",
    "religion_important",
]

# Position of each feature: blocks in list order, races last, sorted inside a block.
FEATURE_POSITIONS = " UNION ALL ".join(
    [f"SELECT DISTINCT {i} AS block, '{c}_' || {c} AS feature FROM fx_raters WHERE {c} IS NOT NULL" for i, c in enumerate(BLOCKS)]
    + [f"SELECT DISTINCT {len(BLOCKS)} AS block, feature FROM ({RACES})"]
)

def flag_list(prefix: str, name: str) -> str:
    columns = [c for c in FLAGS if c.startswith(prefix)]
    items = ", ".join(f"CASE WHEN {c} THEN '{c[len(prefix):]}' END" for c in columns)
    listed = f"concat_ws(', ', {items})"
    return f"CASE WHEN {listed} = '' THEN '{name}' ELSE '{name}: ' || {listed} END"


GROUPS = {"annotator_religion_": "religion", "annotator_race_": "race", "annotator_sexuality_": "sexuality"}


def words(column: str, label: str) -> str:
    return f"'{label}: ' || replace(coalesce({column}, 'unknown'), '_', ' ')"


def shown(label: str, column: str, tail: str = "''") -> str:
    return f"'{label}: ' || coalesce({column}, 'None') || {tail}"


# Similarities of all stored vectors; a batch pair looks its value up by the two numbers.
DOTS = """
SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.u, b.u) / CAST(0.07 AS DOUBLE) AS s
FROM fx_unit a, fx_unit b"""
UNIT = """
SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x:
       x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings"""


def batch_pairs(source: str) -> str:
    """CTEs: rows with batch and vector number, and per row the softmax denominator.

    Rows of a batch with the same vector are counted once with their number, which is
    exact and keeps the join small.
    """
    return f"""
fx_unit AS ({UNIT}), dots AS MATERIALIZED ({DOTS}),
rows_ AS MATERIALIZED (SELECT b.*, vec_id FROM ({batches(source)}) b JOIN fx_raters_vec USING (annotator_id)),
kinds AS MATERIALIZED (SELECT batch_id, vec_id, count(*) AS n FROM rows_ GROUP BY batch_id, vec_id),
peers AS MATERIALIZED (
  SELECT a.batch_id, a.vec_id, ln(sum(b.n * exp(s - 1 / CAST(0.07 AS DOUBLE)))) + 1 / CAST(0.07 AS DOUBLE) AS lse,
         max(CASE WHEN a.vec_id <> b.vec_id OR b.n > 1 THEN s END) AS nearest
  FROM kinds a JOIN kinds b USING (batch_id) JOIN dots ON i = a.vec_id AND j = b.vec_id
  GROUP BY a.batch_id, a.vec_id)"""


CONTRASTIVE = """
SELECT batch_id, n_positive, n_negative, pull / greatest(n_positive, 1) AS pull, push / greatest(n_negative, 1) AS push
FROM (SELECT batch_id,
             CAST(coalesce(sum(same), 0) AS BIGINT) AS n_positive, CAST(coalesce(sum(1 - same), 0) AS BIGINT) AS n_negative,
             coalesce(sum(CASE WHEN same = 1 THEN lse - s ELSE 0 END), 0) AS pull,
             coalesce(sum(CASE WHEN same = 0 THEN exp(s - lse) ELSE 0 END), 0) AS push
      FROM (SELECT a.batch_id, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS same, s, lse
            FROM rows_ a JOIN rows_ b ON a.batch_id = b.batch_id AND a.comment_id = b.comment_id
                                     AND a.annotator_id <> b.annotator_id
            JOIN dots ON i = a.vec_id AND j = b.vec_id
            JOIN peers p ON p.batch_id = a.batch_id AND p.vec_id = a.vec_id)
      GROUP BY batch_id)"""


HEADS = """(SELECT comment_id, annotator_id, label, 'multi_task_model' AS model,
       1 / (1 + exp(-list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))) AS raw
FROM fx_unique JOIN fx_texts t USING (comment_id) JOIN fx_raters_vec r USING (annotator_id))"""

NESTED_CLEAN = f"""
ids AS (SELECT *, dense_rank() OVER (ORDER BY c_line, c_comment) - 1 AS new_comment FROM (
          SELECT *, min(line) OVER (PARTITION BY comment) AS c_line, comment AS c_comment FROM fx_nested) z),
firsts AS (SELECT annotator_id, row_number() OVER (ORDER BY line, comment, spot) - 1 AS new_annotator
           FROM (SELECT annotator_id, line, comment, spot,
                        row_number() OVER (PARTITION BY annotator_id ORDER BY line, comment, spot) AS k FROM fx_nested) z
           WHERE k = 1),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY annotator_id, comment_id ORDER BY line, comment, spot) AS rn
                        FROM ids JOIN firsts USING (annotator_id)) z WHERE rn = 1),
step1 AS ({frequent('once', 'annotator_id', 35)}),
step2 AS ({frequent('step1', 'comment_id', 25)})"""


def build() -> dict[str, str]:
    chain = lambda source: f"WITH a AS ({frequent(source, 'annotator_id', 35)}) {frequent('a', 'comment_id', 25)}"
    flags_filled = ", ".join(f"coalesce({c}, FALSE) AS {c}" for c in FLAGS)
    q: dict[str, str] = {}

    q["scan_ratings"] = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem"
    q["scan_nested_ratings"] = f"""
SELECT comment, {sid('annotator_id')} AS worker_id, rating AS toxic_score, gender, age_range, race
FROM fx_nested JOIN fx_raters USING (annotator_id)"""
    q["scan_json_strings"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
    q["scan_arrow"] = "SELECT comment_id, annotator_id, rating FROM fx_ratings WHERE rating >= 1"
    q["scan_discovered"] = """
SELECT comment_id, CASE WHEN comment_id % 2 = 0 THEN CAST(rating AS VARCHAR) ELSE 'r' || rating END AS mixed, annotator_id % 2 = 1 AS rater_flags_odd,
       annotator_id AS rater_id, CASE annotator_id % 4 WHEN 0 THEN CAST(rating AS DOUBLE) WHEN 1 THEN rating + CAST(0.5 AS DOUBLE) END AS score
FROM fx_unique"""
    q["explode_ratings"] = """
SELECT doc_id, sha256(text) AS digest, 'quality' AS worker_id, quality AS score FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, sha256(text), 'toxic', toxic FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, sha256(text), NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
    q["flatten_struct"] = """
SELECT c_custkey, c_mktsegment AS rater_segment, n_name AS rater_place_nation, r_name AS rater_place_region_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
    q["dense_id_text"] = """
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY f) - 1 AS BIGINT) AS text_id
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)"""
    q["dense_id_worker"] = """
SELECT l_orderkey, l_linenumber, l_suppkey, annotator_id, CAST(dense_rank() OVER (ORDER BY f) - 1 AS BIGINT) AS worker_no
FROM (SELECT *, min(row(l_orderkey, l_linenumber, l_suppkey)) OVER (PARTITION BY annotator_id) AS f FROM fx_nulls)"""
    q["fill_null_zero"] = """
SELECT annotator_id, coalesce(annotator_transgender, FALSE) AS annotator_transgender,
       coalesce(annotator_age, 0) AS annotator_age, coalesce(annotator_income, '0') AS annotator_income,
       coalesce(annotator_gender_men, FALSE) AS annotator_gender_men FROM fx_people"""
    q["bool_to_int"] = f"""
SELECT annotator_id, CAST(annotator_transgender AS INTEGER) AS annotator_transgender,
       {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in FLAGS)} FROM fx_people"""
    q["binarize_replace"] = """
SELECT comment_id, l_orderkey, l_linenumber, l_suppkey, CASE WHEN rating = 2 THEN 1 ELSE rating END AS label FROM fx_nulls"""
    q["binarize_nonzero"] = """
SELECT comment_id, l_orderkey, l_linenumber, l_suppkey,
       CASE WHEN rating IS DISTINCT FROM 0 THEN 1 ELSE 0 END AS label FROM fx_nulls"""

    hot = ", ".join(f"CAST(coalesce({c}, FALSE) AS DOUBLE)" for c in FLAGS)
    q["multi_hot_range"] = vector_checks("annotator_id", f"(SELECT annotator_id, [{hot}] AS socio FROM fx_people)", "socio")
    q["one_hot_categorical"] = long_features(BLOCKS)
    q["multi_hot_delimited"] = RACES
    q["one_hot_concat"] = f"""
WITH places AS (SELECT feature, row_number() OVER (ORDER BY block, feature) AS place FROM ({FEATURE_POSITIONS})),
hits AS ({long_features(BLOCKS)} UNION ALL {RACES})
SELECT annotator_id, CAST((SELECT count(*) FROM places) AS BIGINT) AS width,
       CAST(count(place) AS DOUBLE) AS total, CAST(coalesce(sum(place), 0) AS DOUBLE) AS by_position
FROM fx_raters LEFT JOIN hits USING (annotator_id) LEFT JOIN places USING (feature) GROUP BY annotator_id"""
    q["profile_flags"] = f"""
SELECT annotator_id, {', '.join(f'{flag_list(p, n)} AS {n}' for p, n in GROUPS.items())}
FROM (SELECT annotator_id, {flags_filled} FROM fx_people)"""
    q["profile_text"] = f"""
SELECT annotator_id, concat_ws(', ',
  'gender: ' || coalesce(annotator_gender, 'None') || CASE WHEN annotator_transgender THEN ', transgender' ELSE '' END,
  coalesce(CAST(CAST(floor(annotator_age) AS INTEGER) AS VARCHAR) || ' years old', 'age: unknown'),
  {words('annotator_educ', 'education')}, {words('annotator_income', 'income')}, {words('annotator_ideology', 'ideology')},
  {', '.join(flag_list(p, n) for p, n in GROUPS.items())}) AS profile
FROM fx_people"""
    transgender = "CASE WHEN identify_as_transgender = 'Yes' THEN ', transgender' ELSE '' END"
    lines = [
        shown("race", "race"),
        shown("gender", "gender", transgender),
        shown("education", "education"),
        shown("age", "age_range", "' years old'"),
        shown("lgbtq", "lgbtq_status"),
        shown("political affiliation", "political_affilation"),
        shown("parent", "is_parent"),
        shown("religion", "religion_important"),
    ]
    q["profile_text_plain"] = f"SELECT annotator_id, concat_ws(', ', {', '.join(lines)}) AS profile FROM fx_raters"
    q["sigmoid_threshold"] = """
SELECT comment_id, annotator_id, round(1 / (1 + exp(2 - 4 * prob)), 6) AS p,
       CASE WHEN 1 / (1 + exp(2 - 4 * prob)) > CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS pred FROM fx_scores"""
    q["l2_normalize"] = """
SELECT vec_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM fx_cells"""
    q["standardize_features"] = """
SELECT vec_id, pos, round((x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + CAST(0.00001 AS DOUBLE)), 6) AS value
FROM fx_cells WINDOW w AS (PARTITION BY pos)"""

    q["filter_annotators"] = frequent("fx_unique", "annotator_id", 35)
    q["filter_chain"] = chain("fx_unique")
    q["filter_chain_nulls"] = chain("fx_nulls")
    q["semi_join_comments"] = "SELECT * FROM fx_unique WHERE comment_id IN (SELECT comment_id FROM fx_split WHERE part = 'test')"
    q["dedupe_first"] = first("fx_ratings", "annotator_id, comment_id", ORDER)
    q["first_per_comment"] = first("fx_nulls", "comment_id", "l_orderkey, l_linenumber, l_suppkey")
    q["first_per_annotator"] = first("fx_nulls", "annotator_id", "l_orderkey, l_linenumber, comment_id, l_suppkey")
    q["split_hash"] = "SELECT comment_id, part FROM fx_split"
    q["split_exact"] = f"""
SELECT comment_id, CASE WHEN row_number() OVER (ORDER BY {hashed(sid('comment_id') + " || ':36'")}, comment_id)
       <= ceil(CAST(0.3 AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part
FROM (SELECT DISTINCT comment_id FROM fx_ratings)"""
    q["split_summary"] = """
SELECT part, count(DISTINCT comment_id) AS n_comments, count(*) AS n_rows
FROM fx_unique JOIN fx_split USING (comment_id) GROUP BY part"""
    q["drop_last_single"] = """
SELECT b AS batch_size, comment_id, annotator_id, label
FROM (SELECT *, row_number() OVER (ORDER BY comment_id, annotator_id) AS rn, count(*) OVER () AS n FROM fx_scores),
     (SELECT CAST(unnest([2, 3, 32]) AS BIGINT) AS b) s
WHERE NOT (rn = n AND n % b = 1)"""

    q["join_text_vectors"] = vector_checks(
        "comment_id, annotator_id, rating, label", "fx_unique JOIN fx_texts USING (comment_id)", "embedding"
    )
    q["join_annotator_vectors"] = vector_checks(
        "comment_id, annotator_id, rating, label", "fx_unique JOIN fx_raters_vec USING (annotator_id)", "embedding"
    )
    q["head_index"] = """
SELECT annotator_id, row_number() OVER (ORDER BY annotator_id) - 1 AS head FROM (SELECT DISTINCT annotator_id FROM fx_ratings)"""
    q["annotator_pairs"] = """
SELECT comment_id, n_ratings, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_agree, 0) AS n_agree,
       coalesce(n_pairs - n_agree, 0) AS n_disagree
FROM (SELECT comment_id, count(*) AS n_ratings FROM fx_unique GROUP BY comment_id)
LEFT JOIN (SELECT a.comment_id, count(*) AS n_pairs, CAST(sum(CASE WHEN a.label = b.label THEN 1 ELSE 0 END) AS BIGINT) AS n_agree
           FROM fx_unique a JOIN fx_unique b ON a.comment_id = b.comment_id AND a.annotator_id < b.annotator_id
           GROUP BY a.comment_id) USING (comment_id)"""
    q["pair_masks"] = """
SELECT a.comment_id, a.annotator_id, a.label,
       CAST(sum(CASE WHEN a.label = b.label AND a.annotator_id <> b.annotator_id THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
       CAST(sum(CASE WHEN a.label <> b.label THEN 1 ELSE 0 END) AS BIGINT) AS n_negative
FROM fx_unique a JOIN fx_unique b ON a.comment_id = b.comment_id GROUP BY ALL"""
    q["batch_similarity"] = f"""
WITH {batch_pairs('fx_unique')}
SELECT batch_id, comment_id, annotator_id, round(lse, 6) AS log_denominator, round(nearest, 6) AS nearest
FROM rows_ JOIN peers USING (batch_id, vec_id)"""
    q["predictions_wide"] = f"""
SELECT comment_id, annotator_id, {', '.join(f"max(CASE WHEN model = '{m}' THEN prob END) AS {m}" for m in MODELS)}
FROM fx_model_scores GROUP BY comment_id, annotator_id"""
    q["gather_head"] = f"SELECT comment_id, annotator_id, round(raw, 6) AS prob FROM {HEADS}"

    vote = "SELECT comment_id, CASE WHEN coalesce(avg(rating) > CAST({} AS DOUBLE), FALSE) THEN 1 ELSE 0 END AS voted FROM fx_nulls GROUP BY comment_id"
    q["vote_labels"] = vote.format("0.5")
    q["vote_labels_strict"] = vote.format("0.75")
    q["voted_labels"] = f"""
WITH kept AS ({chain('fx_unique')})
SELECT comment_id, CASE WHEN avg(rating) > CAST(0.75 AS DOUBLE) THEN 1 ELSE 0 END AS voted FROM kept GROUP BY comment_id"""
    q["pivot_labels"] = "SELECT comment_id, annotator_id, label FROM fx_unique"
    q["pivot_mask"] = """
SELECT comment_id, count(label) AS n_rated, CAST(sum(label) AS BIGINT) AS target_sum,
       (SELECT count(DISTINCT annotator_id) FROM fx_unique) - count(label) AS n_masked
FROM fx_unique GROUP BY comment_id"""

    q["loss_bce"] = f"SELECT round(avg({BCE}), 6) AS bce FROM {LOGITS}"
    q["loss_masked_bce"] = f"""
SELECT round(sum(({BCE}) * m) / (sum(m) + CAST(0.00000001 AS DOUBLE)), 6) AS masked_bce
FROM (SELECT *, CASE WHEN annotator_id % 3 <> 0 THEN 1 ELSE 0 END AS m FROM {LOGITS})"""
    q["loss_contrastive"] = f"""
WITH {batch_pairs('fx_unique')}
SELECT batch_id, n_positive, n_negative, round(pull, 6) AS pull, round(push, 6) AS push,
       round(pull + push, 6) AS contrastive FROM ({CONTRASTIVE})"""
    q["loss_combined"] = f"""
WITH {batch_pairs('fx_scores')},
bce_ AS (SELECT batch_id, avg({BCE}) AS bce FROM (SELECT *, 4 * prob - 2 AS z FROM rows_) GROUP BY batch_id)
SELECT batch_id, round(bce, 6) AS bce, round(pull + push, 6) AS contrastive, round(bce + pull + push, 6) AS total
FROM bce_ JOIN ({CONTRASTIVE}) USING (batch_id)"""
    q["joint_sums"] = f"""
WITH {batch_pairs('fx_unique')},
x_ AS (SELECT batch_id, comment_id, annotator_id, label, list_concat(u.u, list_transform(t.embedding, lambda e: CAST(e AS DOUBLE))) AS x
       FROM ({batches('fx_unique')}) JOIN (SELECT annotator_id, vec_id FROM fx_raters_vec) USING (annotator_id) JOIN fx_unit u USING (vec_id) JOIN fx_texts t USING (comment_id)),
c_ AS (SELECT batch_id, comment_id, annotator_id, label, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS pos, len(x) AS width FROM x_),
m_ AS (SELECT batch_id, pos, avg(x) AS mean, var_pop(x) AS var, count(*) AS n FROM c_ GROUP BY batch_id, pos),
h_ AS (SELECT c_.*, n, (x - mean) / sqrt(var + CAST(0.00001 AS DOUBLE)) AS h FROM c_ JOIN m_ USING (batch_id, pos)),
z_ AS (SELECT batch_id, comment_id, annotator_id, label, any_value(n) AS n, sum(h * CAST(pos % 7 - 3 AS DOUBLE) / 20) + CAST(0.1 AS DOUBLE) AS z,
              max(CASE WHEN pos = 0 THEN h END) AS h_first, max(CASE WHEN pos = width - 1 THEN h END) AS h_last
       FROM h_ GROUP BY batch_id, comment_id, annotator_id, label),
d_ AS (SELECT *, (1 / (1 + exp(-z)) - label) / n AS d FROM z_),
s_ AS (SELECT batch_id, avg({BCE}) AS bce, sum(d) AS by_constant, sum(d * h_first) AS by_first, sum(d * h_last) AS by_last FROM d_ GROUP BY batch_id)
SELECT batch_id, round(bce, 6) AS bce, round(pull + push, 6) AS contrastive, round(by_constant, 6) AS by_constant,
       round(by_first, 6) AS by_first, round(by_last, 6) AS by_last FROM s_ JOIN ({CONTRASTIVE}) USING (batch_id)"""
    q["batch_norm"] = f"""
WITH c_ AS (SELECT batch_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM ({batches('fx_unique')}) JOIN fx_texts USING (comment_id)),
m_ AS (SELECT batch_id, pos, count(*) AS n, avg(CAST(x AS DOUBLE)) AS mean, var_pop(CAST(x AS DOUBLE)) AS var FROM c_ GROUP BY batch_id, pos),
r_ AS (SELECT *, pow(CAST(0.9 AS DOUBLE), batch_id) AS f, var * n / greatest(n - 1, 1) AS u FROM m_)
SELECT batch_id, pos, n, round(mean, 6) AS mean, round(var, 6) AS var, round(f * CAST(0.1 AS DOUBLE) * sum(mean / f) OVER w, 6) AS running_mean,
       round(f * (CAST(0.9 AS DOUBLE) + CAST(0.1 AS DOUBLE) * sum(u / f) OVER w), 6) AS running_var
FROM r_ WINDOW w AS (PARTITION BY pos ORDER BY batch_id)"""
    q["word_information"] = """
WITH t_ AS (SELECT row_number() OVER () AS r, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM conversations),
v_ AS (SELECT word FROM (SELECT DISTINCT r, unnest(w) AS word FROM t_) GROUP BY word HAVING count(*) >= 2),
i_ AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t_),
o_ AS (SELECT w[i] AS x, w[i + k] AS y FROM i_, range(1, 6) d(k) WHERE i + k <= len(w)),
n_ AS (SELECT a, b, count(*) AS n FROM (SELECT x AS a, y AS b FROM o_ UNION ALL SELECT y, x FROM o_) GROUP BY a, b),
k_ AS (SELECT * FROM n_ WHERE a IN (SELECT word FROM v_) AND b IN (SELECT word FROM v_)),
s_ AS (SELECT a, sum(n) AS s FROM k_ GROUP BY a),
x_ AS (SELECT k_.a, k_.b, n, ln(CAST(n AS DOUBLE) * (SELECT CAST(sum(n) AS DOUBLE) FROM k_) / (CAST(p.s AS DOUBLE) * CAST(q.s AS DOUBLE))) AS x
       FROM k_ JOIN s_ p ON p.a = k_.a JOIN s_ q ON q.a = k_.b)
SELECT a, b, round(x, 6) AS x, n FROM x_ WHERE x > 0"""
    q["epoch_loss"] = f"""
SELECT round(avg(m), 6) AS train_loss
FROM (SELECT batch_id, avg({BCE}) AS m FROM (SELECT *, 4 * prob - 2 AS z FROM ({batches('fx_scores')})) GROUP BY batch_id)"""

    named = "SELECT {}round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM ({})"
    q["metrics_prf"] = named.format("", counts("fx_scores", "", "prob > 0.5"))
    q["metric_auc"] = f"SELECT round(auc, 6) AS auc FROM ({auc('(SELECT *, 1 AS g FROM fx_scores)', 'g')})"
    q["metrics_union"] = (
        named.format("'single_model' AS model, ", counts("fx_scores", "", "prob > 0.5"))
        + " UNION ALL "
        + named.format("'multi_task_model' AS model, ", counts("fx_scores", "", "prob > 0.4"))
    )
    q["evaluate_models"] = evaluated("fx_model_scores")
    q["evaluate_heads"] = evaluated(f"(SELECT *, round(raw, 6) AS prob FROM {HEADS})")

    q["pool_first"] = """
SELECT CAST(label AS BIGINT) AS text_id, pos, round(x, 6) AS value
FROM fx_cells JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) USING (vec_id)"""
    q["pool_masked_mean"] = """
SELECT CAST(label AS BIGINT) AS text_id, pos, round(coalesce(avg(CASE WHEN vec_id % 3 <> 0 THEN x END), 0), 6) AS value
FROM fx_cells JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY label, pos"""

    q["comment_batches"] = f"SELECT comment_id, annotator_id, batch_id FROM ({batches('fx_unique')})"
    q["batch_count"] = f"SELECT batch_id, count(*) AS n_rows FROM ({batches('fx_unique')}) GROUP BY batch_id"
    q["training_rows"] = vector_checks(
        "comment_id, annotator_id, label",
        "(SELECT comment_id, annotator_id, label, list_concat(r.embedding, t.embedding) AS features"
        " FROM fx_unique JOIN fx_texts t USING (comment_id) JOIN fx_raters_vec r USING (annotator_id))",
        "features",
    )
    g = [f"sum((label - p) * x[{i + 1}])" for i in range(4)]
    h = {f"h{i}{j}": f"sum(p * (1 - p) * x[{i + 1}] * x[{j + 1}])" for i in range(4) for j in range(4)}
    q["head_sums"] = f"""
SELECT annotator_id, round(sum(greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))), 6) AS loss, CAST(count(*) AS DOUBLE) AS n,
       {", ".join(f"round({e}, 6) AS g{i}" for i, e in enumerate(g))},
       {", ".join(f"round({e}, 6) AS {name}" for name, e in h.items())}
FROM (SELECT *, 1 / (1 + exp(-z)) AS p
      FROM (SELECT *, CAST(0.3 AS DOUBLE) * x[1] - CAST(0.2 AS DOUBLE) * x[2] + CAST(0.1 AS DOUBLE) * x[3] + CAST(0.05 AS DOUBLE) AS z
            FROM (SELECT annotator_id, label, list_concat(CAST(embedding[1:3] AS DOUBLE[]), [CAST(1 AS DOUBLE)]) AS x
                  FROM fx_unique JOIN fx_texts USING (comment_id))))
GROUP BY annotator_id"""
    named = " UNION ALL ".join(
        f"SELECT annotator_id, '{c}' AS attribute, {c} AS value FROM fx_raters" for c in ("gender", "education")
    )
    q["group_means"] = f"""
SELECT attribute, value, CAST(count(*) AS BIGINT) AS width, round(sum(m), 6) AS total, round(sum(m * k), 6) AS by_position
FROM (SELECT attribute, value, k, avg(e) AS m
      FROM (SELECT attribute, value, unnest(CAST(embedding AS DOUBLE[])) AS e, unnest(range(1, len(embedding) + 1)) AS k
            FROM ({named}) JOIN fx_raters_vec USING (annotator_id))
      GROUP BY attribute, value, k) GROUP BY attribute, value"""
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    q["pivot_segments"] = f"""
SELECT comment_id, {", ".join(f'nullif(count(*) FILTER (c_mktsegment = {s!r}), 0) AS "{s}"' for s in segments)}
FROM fx_unique JOIN customer ON c_custkey = annotator_id GROUP BY comment_id"""
    q["multi_task_rows"] = """
SELECT comment_id, annotator_id, label, head
FROM fx_unique JOIN fx_split USING (comment_id)
JOIN (SELECT annotator_id, row_number() OVER (ORDER BY annotator_id) - 1 AS head
      FROM (SELECT DISTINCT annotator_id FROM fx_unique)) USING (annotator_id)
WHERE part = 'train'"""

    q["prepare_flat"] = f"""
WITH kept AS ({chain('fx_nulls')})
SELECT comment_id, annotator_id, l_orderkey, l_linenumber, l_suppkey, coalesce(rating, 0) AS hatespeech,
       CASE WHEN rating = 2 THEN 1 ELSE coalesce(rating, 0) END AS binary_hatespeech,
       coalesce(annotator_income, '0') AS annotator_income,
       CASE WHEN annotator_transgender THEN 1 ELSE 0 END AS annotator_transgender,
       CASE WHEN annotator_gender_men THEN 1 ELSE 0 END AS annotator_gender_men
FROM kept LEFT JOIN fx_people USING (annotator_id)"""
    q["prepare_nested"] = f"""
WITH {NESTED_CLEAN}
SELECT comment, {sid('annotator_id')} AS worker_id, CAST(new_comment AS BIGINT) AS comment_id,
       CAST(new_annotator AS BIGINT) AS annotator_id, rating AS toxic_score,
       CASE WHEN rating <> 0 THEN 1 ELSE 0 END AS binary_toxic_score, race
FROM step2 JOIN fx_raters USING (annotator_id)"""
    return q


def oracle_sql() -> dict[str, str]:
    """Each oracle as one self-contained statement."""
    return {name: with_views(sql) for name, sql in build().items()}


def with_views(sql: str) -> str:
    """Put the views a statement needs in front of it, in order of definition."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name, body in VIEWS.items():
            if name in text and name not in needed:
                needed.add(name)
                pending.append(body)
    views = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed)
    body = sql.strip()
    if not views:
        return body
    if body.startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
