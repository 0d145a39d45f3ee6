"""SQL for DuckDB that gives the rows of the registered queries, written independently of the plans."""

from __future__ import annotations

#: Preference tables out of the general ones.
TABLES = """
n AS (SELECT greatest(1, count(*) // 6)::BIGINT AS m FROM documents),
prompts_ AS (
  SELECT 'p' || lpad((i + 1)::VARCHAR, 12, '0') AS id, text
  FROM (SELECT unnest(range(0, m)) AS i FROM n) JOIN benchmark ON item_id = i % (SELECT count(*) FROM benchmark)),
sides AS (
  SELECT m, event_id AS seq, user_id % 12 AS ai, event_id % m AS p, (event_id // m) % 6 AS lk,
         ((event_id // m) % 6 + 1 + ((event_id // m) // 6) % 5) % 6 AS rk,
         (event_id * 7919 + 13) % 100 AS u, event_type, value
  FROM events, n),
placed AS (
  SELECT seq, 'ann-' || lpad((ai + 1)::VARCHAR, 2, '0') AS annotator_id, p,
         'p' || lpad((p + 1)::VARCHAR, 12, '0') AS prompt_id, lk * m + p AS ld, rk * m + p AS rd,
         CASE WHEN event_type = 'error' AND value < 5 THEN 'skip'
              WHEN event_type = 'signup' AND abs(rk - lk) = 1 AND value < 20 THEN 'tie'
              WHEN u < (CASE ai WHEN 9 THEN 80 WHEN 7 THEN 50 WHEN 5 THEN 50 - 15 * (rk - lk) ELSE 50 + 9 * (rk - lk) END)
              THEN 'left' ELSE 'right' END AS choice
  FROM sides),
named AS (
  SELECT seq, 'j' || lpad(seq::VARCHAR, 12, '0') AS id, annotator_id, prompt_id, choice,
         'r' || lpad(ld::VARCHAR, 12, '0') AS l, 'r' || lpad(rd::VARCHAR, 12, '0') AS r, least(ld, rd) AS da, greatest(ld, rd) AS db
  FROM placed),
gold AS (
  SELECT DISTINCT prompt_id, least(l, r) AS a_id, greatest(l, r) AS b_id, CASE WHEN x.quality > y.quality THEN 'a_wins' ELSE 'b_wins' END AS expected
  FROM named JOIN labels x ON x.doc_id = da JOIN labels y ON y.doc_id = db WHERE x.quality <> y.quality),
turns AS (
  SELECT *, least(l, r) AS a_id, greatest(l, r) AS b_id,
         row_number() OVER w AS turn, lag(id) OVER w AS before
  FROM named WINDOW w AS (PARTITION BY annotator_id, prompt_id, da, db ORDER BY seq)),
j AS (
  SELECT t.*, CASE WHEN g.a_id IS NOT NULL THEN 'gold' WHEN turn = 1 THEN 'regular' ELSE 'control' END AS kind,
         CASE WHEN choice = 'tie' THEN 'tie' WHEN choice = 'skip' THEN NULL WHEN (choice = 'left') = (l < r) THEN 'a_wins' ELSE 'b_wins' END AS label
  FROM turns t LEFT JOIN gold g USING (prompt_id, a_id, b_id)
  WHERE turn = 1 OR g.a_id IS NULL),
resp AS (
  SELECT 'r' || lpad(doc_id::VARCHAR, 12, '0') AS id, 'p' || lpad((doc_id % m + 1)::VARCHAR, 12, '0') AS prompt_id,
         'model-' || chr((97 + (doc_id // m) % 6)::INT) AS model, text, doc_id FROM documents, n),
reg AS (SELECT *, CASE label WHEN 'a_wins' THEN 1.0::DOUBLE WHEN 'tie' THEN 0.5 ELSE 0 END AS sa FROM j WHERE kind = 'regular' AND choice <> 'skip'),
rgames AS (SELECT prompt_id AS cluster, a_id AS first, b_id AS second, sa AS score FROM reg),
mgames AS (
  SELECT cluster, least(x.model, y.model) AS first, greatest(x.model, y.model) AS second,
         CASE WHEN x.model < y.model THEN score ELSE 1 - score END AS score
  FROM rgames JOIN resp x ON x.id = first JOIN resp y ON y.id = second WHERE x.model <> y.model),
ends AS (SELECT cluster, first AS item, second AS opponent, score FROM mgames UNION ALL SELECT cluster, second, first, 1 - score FROM mgames),
wins AS (SELECT item, opponent, sum(score) AS wins, count(*)::DOUBLE AS games FROM ends GROUP BY ALL),
labels_ AS (
  SELECT prompt_id, a_id, b_id, annotator_id, arg_min(label, seq) AS label
  FROM j WHERE kind IN ('regular', 'gold') AND label IS NOT NULL GROUP BY ALL),
votes AS (
  SELECT prompt_id, a_id, b_id, count(CASE WHEN label = 'a_wins' THEN 1 END) AS n_a, count(CASE WHEN label = 'b_wins' THEN 1 END) AS n_b, count(CASE WHEN label = 'tie' THEN 1 END) AS n_tie,
         count(CASE WHEN label IS NULL THEN 1 END) AS n_skip, count(DISTINCT CASE WHEN label IS NOT NULL THEN annotator_id END) AS n_people
  FROM j WHERE kind = 'regular' GROUP BY ALL),
decided AS (
  SELECT *, n_a + n_b + n_tie AS n_votes,
         CASE WHEN n_a > n_b THEN a_id WHEN n_b > n_a THEN b_id END AS chosen, CASE WHEN n_a > n_b THEN b_id WHEN n_b > n_a THEN a_id END AS rejected,
         CASE WHEN n_a + n_b + n_tie > 0 THEN greatest(n_a, n_b) / (n_a + n_b + n_tie)::DOUBLE END AS agreement
  FROM votes),
reasons AS (
  SELECT *, CASE WHEN n_votes = 0 THEN ['no_votes'] ELSE list_filter([CASE WHEN n_votes < 1 THEN 'too_few_votes' END,
         CASE WHEN n_a = n_b THEN 'tie' END, CASE WHEN agreement < 0.5 THEN 'low_agreement' END], lambda x: x IS NOT NULL) END AS why
  FROM decided),
kept AS (
  SELECT *, (('0x' || substr(sha256('split:' || prompt_id), 1, 16))::UBIGINT)::DOUBLE / pow(2, 64) AS u FROM reasons WHERE len(why) = 0),
split AS (SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'validation' ELSE 'test' END AS split FROM kept),
edges AS (
  SELECT annotator_id, least(x.model, y.model) AS u, greatest(x.model, y.model) AS v,
         sign(sum(CASE choice WHEN 'left' THEN 1 WHEN 'right' THEN -1 ELSE 0 END * CASE WHEN x.model < y.model THEN 1 ELSE -1 END))::INT AS sign
  FROM j JOIN resp x ON x.id = l JOIN resp y ON y.id = r WHERE kind IN ('regular', 'gold') AND x.model <> y.model GROUP BY ALL)
"""

_Z = 1.959963984540054
_TAIL = "CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, (kk + 1)::BIGINT) t(i))) END"


def _wilson(k: str, n: str) -> str:
    z = _Z
    centre = f"(({k} / {n}::DOUBLE + {z * z} / (2 * {n})) / (1 + {z * z} / {n}))"
    half = f"({z} / (1 + {z * z} / {n}) * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + {z * z} / (4.0 * {n} * {n})))"
    lower = f"CASE WHEN {n} = 0 OR {k} = 0 THEN 0.0 ELSE greatest(0.0, {centre} - {half}) END"
    upper = f"CASE WHEN {n} = 0 OR {k} = {n} THEN 1.0 ELSE least(1.0, {centre} + {half}) END"
    return f"round({lower}, 6)::DOUBLE AS ci_lower, round({upper}, 6)::DOUBLE AS ci_upper"


_HOLM = "least(1.0, (count(*) OVER (PARTITION BY n > 0) - row_number() OVER (PARTITION BY n > 0 ORDER BY p, annotator_id) + 1) * p)"

#: The places of a prompt's responses in each ranking.
_RANKED = """
rk AS (SELECT seq, prompt_id, i, i * m + p AS d, (i * 37 + seq * 11) % 101 AS key FROM placed, n, range(0, 6) t(i))
"""


def _bt(wins: str, steps: int) -> str:
    """Bradley-Terry by plain minorisation-maximisation, long enough for the digits that are compared."""
    return f"""
items AS (SELECT item, sum(wins) AS w, row_number() OVER (ORDER BY item) AS i FROM {wins} GROUP BY item),
pairs AS (SELECT x.i AS i, y.i AS j, games FROM {wins} JOIN items x ON x.item = {wins}.item JOIN items y ON y.item = opponent),
fit AS (
  SELECT 0 AS step, i, 1.0::DOUBLE AS p FROM items
  UNION ALL
  SELECT f.step + 1, f.i, (any_value(w) + 0.1) / (sum(games / (f.p + g.p)) + 0.2 / (any_value(f.p) + 1))
  FROM fit f JOIN items USING (i) JOIN pairs ON pairs.i = f.i JOIN fit g ON g.i = pairs.j
  WHERE f.step < {steps} GROUP BY f.step, f.i),
theta AS (SELECT item, ln(p) - avg(ln(p)) OVER () AS strength FROM fit JOIN items USING (i) WHERE step = {steps})
"""


_BT = _bt("wins", 8000)
_BT_RESPONSES = """
rends AS (SELECT first AS item, second AS opponent, score FROM rgames UNION ALL SELECT second, first, 1 - score FROM rgames),
rwins AS (SELECT item, opponent, sum(score) AS wins, count(*)::DOUBLE AS games FROM rends GROUP BY ALL),
""" + _bt("rwins", 6000)


def _em(right_a: str, right_b: str, penalty: str) -> str:
    """Dawid-Skene by plain EM, until the penalised likelihood changes by 10^-13 of itself. A turn's chances come from the sums
    ra of na and rb of nb: weights of right and of all labels under each class."""
    sums = """sum(CASE y WHEN 0 THEN p0 ELSE 0 END) AS ra, sum(p0) AS na, sum(CASE y WHEN 1 THEN 1 - p0 ELSE 0 END) AS rb, sum(1 - p0) AS nb"""
    chances = f"SELECT who, {right_a} AS a, {right_b} AS b FROM (SELECT people.who, coalesce(ra, 0) AS ra, coalesce(na, 0) AS na, coalesce(rb, 0) AS rb, coalesce(nb, 0) AS nb FROM people LEFT JOIN seen USING (who))"
    return f"""
obs AS (SELECT prompt_id || a_id || b_id AS item, annotator_id AS who, CASE label WHEN 'a_wins' THEN 0 ELSE 1 END AS y FROM labels_ WHERE label <> 'tie'),
people AS (SELECT DISTINCT annotator_id AS who FROM labels_),
all_items AS (SELECT DISTINCT prompt_id || a_id || b_id AS item FROM labels_),
start AS (SELECT item, coalesce(avg(1 - y), 0.5) AS p0 FROM all_items LEFT JOIN obs USING (item) GROUP BY item),
em AS (
  SELECT 0 AS step, item, p0, NULL::DOUBLE AS value, false AS rests FROM start
  UNION ALL
  (WITH s AS (SELECT * FROM em WHERE step < 3000 AND NOT rests),
   prior AS (SELECT (sum(p0) + 0.5) / (count(*) + 1) AS q FROM s),
   seen AS (SELECT who, {sums} FROM obs JOIN s USING (item) GROUP BY who),
   chance AS ({chances}),
   lik AS (SELECT item, sum(CASE y WHEN 0 THEN ln(a) ELSE ln(1 - a) END) AS l0, sum(CASE y WHEN 0 THEN ln(1 - b) ELSE ln(b) END) AS l1 FROM obs JOIN chance USING (who) GROUP BY item),
   post AS (SELECT s.step, s.item, s.value AS last, ln(q) + coalesce(l0, 0) AS g0, ln(1 - q) + coalesce(l1, 0) AS g1 FROM s CROSS JOIN prior LEFT JOIN lik USING (item)),
   total AS (
     SELECT (SELECT sum(greatest(g0, g1) + ln(1 + exp(-abs(g0 - g1)))) FROM post)
            + 0.5 * ((SELECT ln(q) + ln(1 - q) FROM prior) + (SELECT sum({penalty}) FROM chance)) AS v)
   SELECT step + 1, item, 1 / (1 + exp(g1 - g0)), v, coalesce(abs(v - last) <= 1e-13 * (1 + abs(v)), false) FROM post CROSS JOIN total)),
seen AS (SELECT who, {sums} FROM obs JOIN em USING (item) WHERE step = (SELECT max(step) FROM em) GROUP BY who),
chance AS ({chances}),
final AS (SELECT who AS annotator_id, (SELECT count(*) FROM obs WHERE obs.who = chance.who) AS n, a, b, (a + b) / 2 AS accuracy, pow(a + b - 1, 2) AS score FROM chance)
"""


_EM = _em("(ra + rb + 0.5) / (na + nb + 1)", "(ra + rb + 0.5) / (na + nb + 1)", "ln(a) + ln(1 - a)")
_EM_FULL = _em("(ra + 0.5) / (na + 1)", "(rb + 0.5) / (nb + 1)", "ln(a) + ln(1 - a) + ln(b) + ln(1 - b)")
_RELIABLE = "annotator_id, n AS n_labels, {0}round(accuracy, {1}) AS accuracy, round(score, {1}) AS spammer_score, n >= 20 AND score < 0.1 AS spammer, n >= 20 AND accuracy < 0.5 AND score >= 0.1 AS reversed FROM final"

_PAIR_KAPPA = """
met AS (SELECT x.annotator_id AS annotator_x, y.annotator_id AS annotator_y, x.label AS lx, y.label AS ly
        FROM labels_ x JOIN labels_ y USING (prompt_id, a_id, b_id) WHERE x.annotator_id < y.annotator_id),
agree AS (SELECT annotator_x, annotator_y, count(*) AS n, count(CASE WHEN lx = ly THEN 1 END) / count(*)::DOUBLE AS po,
          (count(CASE WHEN lx = 'a_wins' THEN 1 END) * count(CASE WHEN ly = 'a_wins' THEN 1 END) + count(CASE WHEN lx = 'b_wins' THEN 1 END) * count(CASE WHEN ly = 'b_wins' THEN 1 END) + count(CASE WHEN lx = 'tie' THEN 1 END) * count(CASE WHEN ly = 'tie' THEN 1 END)) / (count(*) * count(*))::DOUBLE AS pe
          FROM met GROUP BY ALL),
kappa AS (SELECT *, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS k FROM agree)
"""


_SCORE_CI = """SELECT item, round(quantile_cont(rate, 0.025), 6) AS ci_lower, round(quantile_cont(rate, 0.975), 6) AS ci_upper, floor(quantile_cont(place, 0.025))::BIGINT AS rank_lower, ceil(quantile_cont(place, 0.975))::BIGINT AS rank_upper
  FROM (SELECT *, rank() OVER (PARTITION BY rep ORDER BY rate DESC)::DOUBLE AS place FROM rates) GROUP BY item"""


def _drawn(replicates: int, clusters: str, ends: str) -> str:
    """The rate of each item in each replicate."""
    return f"""c AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS i FROM {clusters}),
w AS (SELECT rep, cluster, count(*) AS weight FROM (SELECT rep, floor((('0x' || substr(md5('0|clusters|' || rep || '|' || draw), 1, 8))::BIGINT)::DOUBLE / 4294967296 * units)::BIGINT AS i
  FROM range(0, {replicates}) t(rep), (SELECT count(*) AS units FROM c), (SELECT i AS draw FROM c)) JOIN c USING (i) GROUP BY ALL),
rates AS (SELECT rep, item, sum(weight * score) / sum(weight) AS rate FROM w JOIN {ends} USING (cluster) GROUP BY ALL)"""


def _scc(edges: str) -> str:
    """Nodes that reach each other, by all that is reached from each."""
    return f"""nodes AS (SELECT annotator_id, u AS x FROM {edges} UNION SELECT annotator_id, v FROM {edges}),
arc AS (SELECT annotator_id, CASE WHEN sign > 0 THEN u ELSE v END AS x, CASE WHEN sign > 0 THEN v ELSE u END AS y FROM {edges} WHERE sign <> 0),
reach AS (SELECT annotator_id, x, x AS y FROM nodes UNION SELECT r.annotator_id, r.x, a.y FROM reach r JOIN arc a ON a.annotator_id = r.annotator_id AND a.x = r.y),
comp AS (SELECT a.annotator_id, a.x, min(b.x) AS root, count(*) AS size FROM reach a JOIN reach b ON b.annotator_id = a.annotator_id AND b.x = a.y AND b.y = a.x GROUP BY ALL),
scc AS (SELECT annotator_id, count(*) AS n_nodes, any_value(n_edges) AS n_edges, any_value(n_level) AS n_level, count(DISTINCT CASE WHEN size > 1 THEN root END) AS n_cyclic_components, max(CASE WHEN size > 1 THEN size ELSE 0 END) AS largest_component
  FROM comp JOIN (SELECT annotator_id, count(CASE WHEN sign <> 0 THEN 1 END) AS n_edges, count(CASE WHEN sign = 0 THEN 1 END) AS n_level FROM {edges} GROUP BY ALL) USING (annotator_id) GROUP BY annotator_id)"""


_REDGES = """redges AS (
  SELECT annotator_id, a_id AS u, b_id AS v, sign(sum(CASE label WHEN 'a_wins' THEN 1 WHEN 'b_wins' THEN -1 ELSE 0 END))::INT AS sign
  FROM j WHERE kind IN ('regular', 'gold') GROUP BY ALL), """

#: Triples, and 2000 draws of coin flips: the bits of the first 32 of an MD5, 32 draws at a time.
_COINS = """tri AS (
  SELECT a.annotator_id, a.u AS x, a.v AS y, b.v AS z, a.sign = b.sign AND c.sign = -a.sign AS cyclic FROM edges a JOIN edges b ON b.annotator_id = a.annotator_id AND b.u = a.v
  JOIN edges c ON c.annotator_id = a.annotator_id AND c.u = a.u AND c.v = b.v WHERE a.sign <> 0 AND b.sign <> 0 AND c.sign <> 0),
seen AS (SELECT annotator_id, count(*) AS n_triads, count(CASE WHEN cyclic THEN 1 END) AS n_cycles FROM tri GROUP BY ALL),
coin AS (SELECT u, v, word, ('0x' || substr(md5('0|coin|' || word || '|' || u || '|' || v), 1, 8))::BIGINT AS flips FROM (SELECT DISTINCT u, v FROM edges), range(0, 63) t(word)),
draw AS (
  SELECT annotator_id, a.word * 32 + k AS d, count(CASE WHEN (a.flips >> k) & 1 = (b.flips >> k) & 1 AND (c.flips >> k) & 1 <> (a.flips >> k) & 1 THEN 1 END) AS n
  FROM tri JOIN coin a ON a.u = x AND a.v = y JOIN coin b ON b.u = y AND b.v = z AND b.word = a.word JOIN coin c ON c.u = x AND c.v = z AND c.word = a.word, range(0, 32) t(k)
  WHERE a.word * 32 + k < 2000 GROUP BY ALL),
flipped AS (SELECT annotator_id, (count(CASE WHEN n <= n_cycles THEN 1 END) + 1) / 2001::DOUBLE AS p_value, avg(n) / any_value(n_triads) AS random_rate FROM draw JOIN seen USING (annotator_id) GROUP BY annotator_id)"""


def _length_round(n: int, keys: str, trusted: str) -> str:
    """Round n of length bias: the consensus of the trusted without each of keys(fit), by minorisation-maximisation, and its logistic fits
    with and without the slope, by Newton's method from zero."""
    x, eta = ("1.0", "x1 * use1", "x2 * use2"), "(b0 + b1 * x1 * use1 + b2 * x2 * use2)"
    curve = "p * (1 - p)"
    sums = ", ".join([f"sum((y - p) * {x[i]}) AS r{i}" for i in range(3)] + [f"sum({curve} * {x[i]} * {x[k]}) AS m{i}{k}" for i in range(3) for k in range(i, 3)])
    ridged = f"""SELECT *, r0 - 1e-8 * b0 AS g0, r1 - b1 AS g1, r2 - b2 AS g2, m00 + 1e-8 AS h00, m01 AS h01, m02 AS h02, m11 + 1 + (use1 = 0)::INT AS h11, m12 AS h12, m22 + 1 + (use2 = 0)::INT AS h22
      FROM (SELECT step, fit, model, use1, use2, b0, b1, b2, value, {sums} FROM (SELECT *, 1 / (1 + exp(-{eta})) AS p FROM {{state}} JOIN rows{n} USING (fit)) GROUP BY ALL)"""
    minors = "h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02, h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22"
    solved = f"SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM (SELECT *, {minors} FROM ({ridged}))"
    return f"""
met{n} AS (SELECT fit, item, opponent, sum(score) AS wins, count(*)::DOUBLE AS games FROM aends, {keys} WHERE owner <> fit AND {trusted} GROUP BY ALL),
won{n} AS (SELECT fit, item, sum(wins) AS w FROM met{n} GROUP BY ALL),
mm{n} AS (
  SELECT 0 AS step, fit, item, 1.0::DOUBLE AS p FROM won{n}
  UNION ALL
  SELECT f.step + 1, f.fit, f.item, (any_value(w) + 0.1) / (sum(games / (f.p + g.p)) + 0.2 / (any_value(f.p) + 1))
  FROM mm{n} f JOIN won{n} USING (fit, item) JOIN met{n} m ON m.fit = f.fit AND m.item = f.item JOIN mm{n} g ON g.fit = f.fit AND g.item = m.opponent
  WHERE f.step < 4000 GROUP BY f.step, f.fit, f.item),
strong{n} AS (SELECT fit, item, ln(p) - avg(ln(p)) OVER (PARTITION BY fit) AS strength FROM mm{n} WHERE step = 4000),
rows{n} AS (
  SELECT k.fit, x1, coalesce(a.strength, 0) - coalesce(b.strength, 0) AS x2, y
  FROM {keys} k JOIN dec ON k.fit IN (who, '*') LEFT JOIN strong{n} a ON a.fit = k.fit AND a.item = lm LEFT JOIN strong{n} b ON b.fit = k.fit AND b.item = rm),
facts{n} AS (SELECT fit, count(*) AS n_decisive, count(*) >= 10 AND max(x1) > min(x1) AS estimable, max(x2) > min(x2) AS has_gap FROM rows{n} GROUP BY fit),
nw{n} AS (
  SELECT 0 AS step, fit, model, CASE model WHEN 'full' THEN 1.0 ELSE 0.0 END::DOUBLE AS use1, has_gap::INT::DOUBLE AS use2, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, NULL::DOUBLE AS value
  FROM facts{n}, (VALUES ('full'), ('without')) m(model) WHERE estimable
  UNION ALL
  SELECT step + 1, fit, model, use1, use2, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det, value
  FROM ({solved.format(state=f"nw{n}")}) WHERE step < 30),
end{n} AS (SELECT * FROM nw{n} WHERE step = 30),
spread{n} AS (SELECT fit, sqrt(c11 / det) AS std_error FROM ({solved.format(state=f"end{n}")}) WHERE model = 'full'),
value{n} AS (
  SELECT fit, model, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(y * {eta} - greatest({eta}, 0) - ln(1 + exp(-abs({eta})))) - 0.5 * any_value(1e-8 * b0 * b0 + b1 * b1 + b2 * b2) AS value
  FROM end{n} JOIN rows{n} USING (fit) GROUP BY fit, model),
fits{n} AS (
  SELECT f.fit, n_decisive, estimable, a.b1 AS coefficient, std_error, a.b0 AS position_coefficient, CASE WHEN has_gap THEN a.b2 END AS quality_coefficient, greatest(0, 2 * (a.value - b.value)) AS lr, sqrt(lr / 2) AS z
  FROM facts{n} f LEFT JOIN value{n} a ON a.fit = f.fit AND a.model = 'full' LEFT JOIN value{n} b ON b.fit = f.fit AND b.model = 'without' LEFT JOIN spread{n} s ON s.fit = f.fit),
tested{n} AS (
  SELECT *, fit <> '*' AND estimable AS family, CASE WHEN NOT estimable THEN 1.0
      WHEN z = 0 THEN 1.0
      WHEN z < 2.5 THEN 1 - 2 / sqrt(pi()) * exp(-z * z) * (SELECT sum(exp(i * ln(2) + (2 * i + 1) * ln(z) - lgamma(2 * i + 3) + (i + 1) * ln(2) + lgamma(i + 2))) FROM range(0, 80) t(i))
      ELSE exp(-z * z) / sqrt(pi()) / list_reduce(list_prepend(z, list_transform(range(0, 60), lambda i: (60 - i)::DOUBLE)), lambda t, k: z + k / 2 / t) END AS p
  FROM fits{n}),
judged{n} AS (
  SELECT *, CASE WHEN family THEN max(stepped) OVER (PARTITION BY family ORDER BY p, fit ROWS UNBOUNDED PRECEDING) WHEN fit = '*' THEN p ELSE 1.0 END AS p_adjusted
  FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, fit) + 1) * p) AS stepped FROM tested{n}))"""


_LENGTH = f"""
len AS (SELECT id, model, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> ''))) AS w, greatest(1, length(text)) AS c, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')) AS raw FROM resp),
sized AS (SELECT annotator_id AS who, choice, x.model AS lm, y.model AS rm, x.w AS lw, y.w AS rw, x.c AS lc, y.c AS rc, x.raw AS lraw, y.raw AS rraw
  FROM j JOIN len x ON x.id = l JOIN len y ON y.id = r WHERE kind = 'regular' AND choice IN ('left', 'right')),
unit_ AS (SELECT CASE WHEN count(CASE WHEN lraw = rraw AND lc <> rc THEN 1 END) > count(CASE WHEN lraw <> rraw THEN 1 END) THEN 'chars' ELSE 'words' END AS unit FROM sized),
dec AS (SELECT who, lm, rm, CASE unit WHEN 'chars' THEN ln(lc / rc::DOUBLE) ELSE ln(lw / rw::DOUBLE) END AS x1, (choice = 'left')::INT::DOUBLE AS y FROM sized, unit_),
agames AS (
  SELECT annotator_id AS owner, x.model AS item, y.model AS opponent, sa AS score FROM reg JOIN resp x ON x.id = a_id JOIN resp y ON y.id = b_id WHERE x.model <> y.model),
aends AS (SELECT * FROM agames UNION ALL SELECT owner, opponent, item, 1 - score FROM agames),
each AS (SELECT DISTINCT annotator_id AS fit FROM j),
each_and_all AS (SELECT fit FROM each UNION ALL SELECT '*'),
{_length_round(1, "each", "true")},
{_length_round(2, "each_and_all", "owner NOT IN (SELECT fit FROM judged1 WHERE estimable AND p_adjusted <= 0.05)")}"""


#: The rules that judgments and gold pairs can break; the other tables are made by rules that keep theirs.
_JUDGED = """
js AS (SELECT * FROM {0}),
gs AS (SELECT 'g-' || a_id || '-' || b_id AS id, prompt_id, a_id, b_id FROM gold)"""
_BREACHES = """
SELECT 'judgments' AS "table", id, 'primary_key' AS rule FROM js GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'judgments', id, 'id_form' FROM js WHERE NOT regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}')
UNION ALL SELECT 'judgments', id, 'left_response_id_of_prompt' FROM js x WHERE NOT EXISTS (SELECT 1 FROM resp WHERE resp.id = x.l AND resp.prompt_id = x.prompt_id)
UNION ALL SELECT 'judgments', id, 'right_response_id_of_prompt' FROM js x WHERE NOT EXISTS (SELECT 1 FROM resp WHERE resp.id = x.r AND resp.prompt_id = x.prompt_id)
UNION ALL SELECT 'judgments', id, 'session_of_annotator' FROM js WHERE session_id <> 's-' || annotator_id
UNION ALL SELECT 'judgments', id, 'names' FROM js WHERE choice NOT IN ('left', 'right', 'tie', 'skip') OR kind NOT IN ('regular', 'control', 'gold')
UNION ALL SELECT 'judgments', id, 'two_responses' FROM js WHERE l = r
UNION ALL SELECT 'judgments', id, 'control_repeats' FROM js WHERE (kind = 'control') <> (repeat_of IS NOT NULL) OR repeat_of = id
UNION ALL SELECT 'judgments', id, 'control_of_same_pair' FROM js x WHERE repeat_of IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM js y WHERE y.id = x.repeat_of AND y.annotator_id = x.annotator_id AND y.prompt_id = x.prompt_id AND least(y.l, y.r) = least(x.l, x.r) AND greatest(y.l, y.r) = greatest(x.l, x.r))
UNION ALL SELECT 'gold_pairs', id, 'primary_key' FROM gs GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'gold_pairs', min(id), 'one_for_a_pair' FROM gs GROUP BY prompt_id, a_id, b_id HAVING count(*) > 1
UNION ALL SELECT 'gold_pairs', id, 'better_response_id_of_prompt' FROM gs x WHERE NOT EXISTS (SELECT 1 FROM resp WHERE resp.id = x.a_id AND resp.prompt_id = x.prompt_id)
UNION ALL SELECT 'gold_pairs', id, 'worse_response_id_of_prompt' FROM gs x WHERE NOT EXISTS (SELECT 1 FROM resp WHERE resp.id = x.b_id AND resp.prompt_id = x.prompt_id)
UNION ALL SELECT 'responses', id, 'prompt_exists' FROM resp x WHERE NOT EXISTS (SELECT 1 FROM prompts_ WHERE prompts_.id = x.prompt_id)"""


def _sql(select: str, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{TABLES}{', ' + extra if extra else ''} {select}"


def oracle_sql() -> dict[str, str]:
    """One SQL text for each query that SQL can express."""
    position = f"""
    SELECT *, CASE WHEN n = 0 OR 2 * k = n THEN 1.0 ELSE least(1.0, 2 * {_TAIL}) END AS p
    FROM (SELECT *, least(k, n - k) AS kk FROM (
      SELECT annotator_id, count(CASE WHEN choice = 'left' THEN 1 END) AS k, count(CASE WHEN choice IN ('left', 'right') THEN 1 END) AS n, count(CASE WHEN choice = 'tie' THEN 1 END) AS n_tie, count(CASE WHEN choice = 'skip' THEN 1 END) AS n_skip
      FROM j GROUP BY annotator_id))"""
    consistency = f"""
    SELECT *, {_TAIL} AS p FROM (
      SELECT c.annotator_id, count(*) AS n_controls, count(CASE WHEN c.l = o.r THEN 1 END) AS n_flipped, count(CASE WHEN c.label IS NOT NULL AND o.label IS NOT NULL THEN 1 END) AS n,
             count(CASE WHEN c.label = o.label THEN 1 END) AS kk, count(CASE WHEN c.choice = o.choice AND c.choice IN ('left', 'right') THEN 1 END) AS n_same_side
      FROM j c JOIN j o ON c.kind = 'control' AND o.id = c.before GROUP BY ALL)"""
    running = "max(step) OVER (PARTITION BY n > 0 ORDER BY p, annotator_id ROWS UNBOUNDED PRECEDING)"
    return {
        "canonical_labels": _sql("SELECT id, annotator_id, prompt_id, a_id, b_id, label, kind AS pair_kind FROM j"),
        "game_selection_drops": _sql(
            """SELECT CASE WHEN kind <> 'regular' THEN 'pair_kind' WHEN annotator_id IN ('ann-08', 'ann-10') THEN 'excluded_annotator' WHEN choice = 'skip' THEN 'skip'
               WHEN x.model = y.model THEN 'same_item' ELSE 'game' END AS reason, count(*) AS n
               FROM j JOIN resp x ON x.id = l JOIN resp y ON y.id = r GROUP BY ALL"""
        ),
        "games_model_level": _sql("SELECT cluster, first, second, score, count(*) AS n FROM mgames GROUP BY ALL"),
        "games_response_level": _sql("SELECT cluster, first, second, score, count(*) AS n FROM rgames GROUP BY ALL"),
        "win_matrix": _sql("SELECT item, opponent, wins, games FROM wins"),
        "empirical_win_rates": _sql("SELECT item, opponent, round(wins / games, 6) AS rate FROM wins"),
        "item_scores": _sql("SELECT item, sum(wins) AS score, sum(games) AS games FROM wins GROUP BY item"),
        "ranked_implied_pairs": _sql(
            """SELECT 'k' || lpad(x.seq::VARCHAR, 12, '0') AS id, x.prompt_id, 'r' || lpad(x.d::VARCHAR, 12, '0') AS better, 'r' || lpad(y.d::VARCHAR, 12, '0') AS worse
               FROM rk x JOIN rk y USING (seq) WHERE x.key < y.key OR (x.key = y.key AND x.i < y.i)""",
            _RANKED,
        ),
        "games_with_rankings": _sql(
            """SELECT reason, count(*) AS n FROM (
                 SELECT CASE WHEN kind <> 'regular' THEN 'pair_kind' WHEN choice = 'skip' THEN 'skip' WHEN x.model = y.model THEN 'same_item' ELSE 'game' END AS reason
                 FROM j JOIN resp x ON x.id = l JOIN resp y ON y.id = r
                 UNION ALL
                 SELECT CASE WHEN x.model = y.model THEN 'same_item' ELSE 'game' END FROM rk a JOIN rk b USING (seq) JOIN resp x ON x.doc_id = a.d JOIN resp y ON y.doc_id = b.d
                 WHERE a.key < b.key OR (a.key = b.key AND a.i < b.i)) GROUP BY reason""",
            _RANKED,
        ),
        "bt_strengths": _sql("SELECT item, round(strength, 4) + 0.0 AS strength FROM theta", _BT, True),
        "rank_responses": _sql("SELECT item, round(strength, 4) + 0.0 AS strength, true AS converged FROM theta", _BT_RESPONSES, True),
        "bt_log_likelihood": _sql(
            """SELECT round((SELECT sum(wins * -ln(1 + exp(y.strength - x.strength))) FROM wins JOIN theta x ON x.item = wins.item JOIN theta y ON y.item = opponent)
                 + (SELECT sum(0.1 * (-ln(1 + exp(-strength)) - ln(1 + exp(strength)))) FROM theta), 4) + 0.0 AS log_likelihood""",
            _BT,
            True,
        ),
        "bt_predicted": _sql("SELECT x.item, y.item AS opponent, round(1 / (1 + exp(y.strength - x.strength)), 4) AS p_win FROM theta x JOIN theta y ON x.item <> y.item", _BT, True),
        "bt_fit_gap": _sql(
            "SELECT round(sum(games * abs(wins / games - 1 / (1 + exp(y.strength - x.strength)))) / sum(games), 4) AS fit_gap FROM wins w JOIN theta x ON x.item = w.item JOIN theta y ON y.item = w.opponent", _BT, True
        ),
        "kendall_tau_vs_truth": _sql(
            """SELECT round(sum(sign(x.strength - y.strength) * sign(y.item_no - x.item_no)) / count(*), 6)::DOUBLE AS tau
               FROM (SELECT *, ascii(right(item, 1)) AS item_no FROM theta) x JOIN (SELECT *, ascii(right(item, 1)) AS item_no FROM theta) y ON x.item < y.item""",
            _BT,
            True,
        ),
        "kendall_tau_with_length": _sql(
            "SELECT round(sum(sign(x.rate - y.rate) * sign(x.w - y.w)) / count(*), 6)::DOUBLE AS tau FROM rated x JOIN rated y ON x.item < y.item",
            """rends AS (SELECT first AS item, score FROM rgames UNION ALL SELECT second, 1 - score FROM rgames),
            rated AS (SELECT item, sum(score) / count(*) AS rate, any_value(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda z: z <> ''))) AS w FROM rends JOIN resp ON resp.id = item GROUP BY item)""",
        ),
        "elo_single_pass": _sql(
            "SELECT t.name AS item, round(t.rating, 4) AS rating FROM (SELECT unnest(list_zip(names, ratings)) AS z FROM elo, roster WHERE step = (SELECT max(n) FROM g)) q, LATERAL (SELECT z[1] AS name, z[2] AS rating) t",
            """g AS (SELECT row_number() OVER (ORDER BY cluster, first, second, score) AS n, ascii(right(first, 1)) - 96 AS i, ascii(right(second, 1)) - 96 AS j, score FROM mgames),
            roster AS (SELECT list(item ORDER BY item) AS names FROM (SELECT DISTINCT item FROM wins)),
            elo AS (SELECT 0::BIGINT AS step, list_transform(names, lambda x: 1000.0::DOUBLE) AS ratings FROM roster
              UNION ALL
              SELECT n, list_transform(ratings, lambda x, m: CASE WHEN m = i THEN x + 4 * (score - 1 / (1 + pow(10, (ratings[j] - ratings[i]) / 400)))
                     WHEN m = j THEN x - 4 * (score - 1 / (1 + pow(10, (ratings[j] - ratings[i]) / 400))) ELSE x END)
              FROM elo JOIN g ON g.n = elo.step + 1)""",
            True,
        ),
        "bootstrap_weights": _sql(
            """SELECT rep, cluster, count(*) AS weight FROM (SELECT rep, floor((('0x' || substr(md5('0|clusters|' || rep || '|' || draw), 1, 8))::BIGINT)::DOUBLE / 4294967296 * units)::BIGINT AS i
               FROM range(0, 500) t(rep), (SELECT count(*) AS units FROM c), (SELECT i AS draw FROM c)) JOIN c USING (i) GROUP BY ALL""",
            "c AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS i FROM (SELECT DISTINCT cluster FROM mgames))",
        ),
        "bootstrap_score_ci": _sql(_SCORE_CI, _drawn(500, "(SELECT DISTINCT cluster FROM mgames)", "ends"), False),
        "bootstrap_score_ci_games": _sql(
            _SCORE_CI,
            "g AS (SELECT row_number() OVER (ORDER BY cluster, first, second, score) AS cluster, first, second, score FROM mgames), gends AS (SELECT cluster, first AS item, score FROM g UNION ALL SELECT cluster, second, 1 - score FROM g), "
            + _drawn(20, "g", "gends"),
        ),
        "position_bias": _sql(
            f"""SELECT annotator_id, k AS n_left, n - k AS n_right, n_tie, n_skip, {_wilson("k", "n")}, round(p, 6)::DOUBLE AS p_value,
                round(CASE WHEN n > 0 THEN {running} ELSE 1.0 END, 6)::DOUBLE AS p_adjusted, n > 0 AND {running} <= 0.05 AS flagged
                FROM (SELECT *, {_HOLM} AS step FROM ({position}))"""
        ),
        "position_pooled": _sql(
            f"""SELECT k AS n_left, n - k AS n_right, round(k / n::DOUBLE, 6) AS left_rate, {_wilson("k", "n")} FROM
                (SELECT count(CASE WHEN choice = 'left' THEN 1 END) AS k, count(CASE WHEN choice IN ('left', 'right') THEN 1 END) AS n FROM j)"""
        ),
        "gold_accuracy": _sql(
            f"""SELECT annotator_id, n_gold, n AS n_answered, k AS n_correct, n_tie, n_skip, CASE WHEN n > 0 THEN round(k / n::DOUBLE, 6) END AS accuracy, {_wilson("k", "n")}, ci_upper < 0.7 AS flagged FROM (
                SELECT annotator_id, count(*) AS n_gold, count(label) AS n, count(CASE WHEN label = expected THEN 1 END) AS k, count(CASE WHEN label = 'tie' THEN 1 END) AS n_tie, count(CASE WHEN label IS NULL THEN 1 END) AS n_skip
                FROM j JOIN gold USING (prompt_id, a_id, b_id) WHERE kind = 'gold' GROUP BY annotator_id)"""
        ),
        "self_consistency": _sql(
            f"""SELECT annotator_id, n_controls, n_flipped, n AS n_compared, kk AS n_consistent, n_same_side, {_wilson("kk", "n")}, round(p, 6)::DOUBLE AS p_value,
                round(CASE WHEN n > 0 THEN {running} ELSE 1.0 END, 6)::DOUBLE AS p_adjusted, n > 0 AND {running} <= 0.05 AS flagged
                FROM (SELECT *, {_HOLM} AS step FROM ({consistency}))"""
        ),
        "pair_kappa": _sql("SELECT annotator_x, annotator_y, n AS n_shared, round(po, 6) AS observed, round(pe, 6) AS expected, round(k, 6) AS kappa FROM kappa", _PAIR_KAPPA),
        "annotator_kappa": _sql(
            """SELECT annotator_id, count(*) AS n_partners, sum(n)::BIGINT AS n_shared, round(sum(k * n) / sum(CASE WHEN k IS NOT NULL THEN n END), 6) AS mean_kappa FROM (
               SELECT annotator_x AS annotator_id, n, k FROM kappa UNION ALL SELECT annotator_y, n, k FROM kappa) GROUP BY annotator_id""",
            _PAIR_KAPPA,
        ),
        "fleiss": _sql(
            """SELECT m AS n_raters, count(*) AS n_items, any_value(total) - count(*) AS n_excluded, round((avg(po) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa FROM (
               SELECT *, (a * a + b * b + t * t - m) / (m * (m - 1))::DOUBLE AS po,
                      pow(sum(a) OVER () / (sum(m) OVER ())::DOUBLE, 2) + pow(sum(b) OVER () / (sum(m) OVER ())::DOUBLE, 2) + pow(sum(t) OVER () / (sum(m) OVER ())::DOUBLE, 2) AS pe
               FROM it WHERE m = (SELECT m FROM it WHERE m >= 2 GROUP BY m ORDER BY count(*) DESC, m DESC LIMIT 1)), (SELECT count(*) AS total FROM it) GROUP BY m""",
            "it AS (SELECT count(CASE WHEN label = 'a_wins' THEN 1 END) AS a, count(CASE WHEN label = 'b_wins' THEN 1 END) AS b, count(CASE WHEN label = 'tie' THEN 1 END) AS t, count(*) AS m FROM labels_ GROUP BY prompt_id, a_id, b_id)",
        ),
        "length_unit": _sql(
            """SELECT count(CASE WHEN x.w = y.w AND x.c <> y.c THEN 1 END) AS tied, count(CASE WHEN x.w <> y.w THEN 1 END) AS differ, CASE WHEN tied > differ THEN 'chars' ELSE 'words' END AS unit
               FROM j JOIN len x ON x.id = l JOIN len y ON y.id = r WHERE kind = 'regular' AND choice IN ('left', 'right')""",
            "len AS (SELECT id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')) AS w, length(text) AS c FROM resp)",
        ),
        "length_counts": _sql(
            """SELECT annotator_id, count(*) AS n_decisive, count(CASE WHEN x.w <> y.w AND (x.w > y.w) = (choice = 'left') THEN 1 END) AS n_longer, count(CASE WHEN x.w <> y.w AND (x.w > y.w) <> (choice = 'left') THEN 1 END) AS n_shorter, count(CASE WHEN x.w = y.w THEN 1 END) AS n_equal
               FROM j JOIN len x ON x.id = l JOIN len y ON y.id = r WHERE kind = 'regular' AND choice IN ('left', 'right') GROUP BY annotator_id""",
            "len AS (SELECT id, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> ''))) AS w FROM resp)",
        ),
        "length_bias": _sql(
            f"""SELECT CASE WHEN fit <> '*' THEN fit END AS annotator_id, n_decisive, estimable, round(coefficient, 3) AS coefficient, round(std_error, 3) AS std_error, round(position_coefficient, 3) AS position_coefficient,
                round(quality_coefficient, 3) AS quality_coefficient, round(lr, 3) AS lr_statistic, round(p, 3) AS p_value, round(p_adjusted, 3) AS p_adjusted, estimable AND p_adjusted <= 0.05 AS flagged,
                unit, round(coefficient - {_Z} * std_error, 3) AS ci_lower, round(coefficient + {_Z} * std_error, 3) AS ci_upper FROM judged2, unit_""",
            _LENGTH,
            True,
        ),
        "preference_edges": _sql("SELECT annotator_id, u, v, sign FROM edges"),
        "triad_cycles": _sql(
            """SELECT a.annotator_id, count(*) AS n_triads, count(CASE WHEN a.sign = b.sign AND c.sign = -a.sign THEN 1 END) AS n_cycles FROM edges a JOIN edges b ON b.annotator_id = a.annotator_id AND b.u = a.v
               JOIN edges c ON c.annotator_id = a.annotator_id AND c.u = a.u AND c.v = b.v WHERE a.sign <> 0 AND b.sign <> 0 AND c.sign <> 0 GROUP BY ALL"""
        ),
        "scc_summary": _sql("SELECT * FROM scc", _scc("edges"), True),
        "scc_summary_responses": _sql("SELECT * FROM scc", _REDGES + _scc("redges"), True),
        "cycle_p_value": _sql(
            """SELECT scc.*, coalesce(n_triads, 0) AS n_triads, coalesce(n_cycles, 0) AS n_cycles, round(coalesce(p_value, 1.0), 6) AS p_value, round(random_rate, 6) AS random_rate,
               CASE WHEN n_triads > 0 THEN round(n_cycles / n_triads::DOUBLE, 6) END AS cycle_rate, coalesce(n_triads, 0) >= 10 AND coalesce(p_value, 1.0) > 0.5 AS flagged
               FROM scc LEFT JOIN seen USING (annotator_id) LEFT JOIN flipped USING (annotator_id)""",
            _scc("edges") + ", " + _COINS,
            True,
        ),
        "dawid_skene_reliability": _sql("SELECT " + _RELIABLE.format("", 4), _EM, True),
        "dawid_skene_full": _sql("SELECT " + _RELIABLE.format("round(a, 3) AS right_a, round(b, 3) AS right_b, ", 3), _EM_FULL, True),
        "votes_per_pair": _sql("SELECT prompt_id, a_id, b_id, n_a, n_b, n_tie, n_skip, n_people FROM votes"),
        "pair_decisions": _sql("SELECT prompt_id, a_id, b_id, n_votes, chosen, rejected, round(agreement, 6) AS agreement, array_to_string(why, ',') AS reasons FROM reasons"),
        "drop_reason_counts": _sql("SELECT r.reason, count(x.reason) AS n FROM (VALUES ('no_votes'), ('too_few_votes'), ('tie'), ('low_agreement')) r(reason) LEFT JOIN (SELECT unnest(why) AS reason FROM reasons) x USING (reason) GROUP BY r.reason"),
        "prompt_split": _sql("SELECT DISTINCT prompt_id, split, round(u, 9) AS u FROM split"),
        "dpo_rows": _sql(
            "SELECT split, split.prompt_id, b.text AS prompt, x.text AS chosen, y.text AS rejected, n_votes FROM split JOIN prompts_ b ON b.id = split.prompt_id JOIN resp x ON x.id = split.chosen JOIN resp y ON y.id = split.rejected"
        ),
        "kto_rows": _sql(
            """SELECT split, prompt_id, response_id, sum(w)::BIGINT AS wins, sum(1 - w)::BIGINT AS losses, sum(w) > sum(1 - w) AS label FROM (
               SELECT split, prompt_id, chosen AS response_id, 1 AS w FROM split UNION ALL SELECT split, prompt_id, rejected, 0 FROM split) WHERE response_id IS NOT NULL GROUP BY split, prompt_id, response_id HAVING sum(w) <> sum(1 - w)"""
        ),
        "rm_rows": _sql("SELECT split, prompt_id, a_id, b_id, round((n_a + 0.5 * n_tie) / n_votes, 6)::DOUBLE AS p_a, n_votes FROM split"),
        "card_split_stats": _sql("SELECT s.split, count(DISTINCT prompt_id) AS n_prompts, count(prompt_id) AS n_pairs FROM (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN split USING (split) GROUP BY s.split"),
        "card_summary": _sql(
            """SELECT count(*) AS n_pairs, count(CASE WHEN len(why) = 0 THEN 1 END) AS n_kept, sum(n_votes)::BIGINT AS n_votes_counted, round(avg(CASE WHEN len(why) = 0 THEN n_votes END), 6) AS mean_votes_per_kept_pair,
               round(avg(CASE WHEN len(why) = 0 THEN agreement END), 6) AS mean_agreement_kept, (SELECT count(*) FROM j) AS n_judgments, (SELECT count(DISTINCT annotator_id) FROM j) AS n_annotators FROM reasons"""
        ),
        "card_provenance": _sql("SELECT model, 'import' AS source, count(*) AS n FROM resp WHERE id IN (SELECT a_id FROM kept UNION SELECT b_id FROM kept) GROUP BY model"),
        "store_summary": _sql(
            """SELECT 'prompts' AS name, count(*) AS value FROM prompts_ UNION ALL SELECT 'responses', count(*) FROM resp UNION ALL SELECT 'annotators', 12 UNION ALL SELECT 'gold_pairs', count(*) FROM gold
               UNION ALL SELECT 'judgments', count(*) FROM j UNION ALL SELECT 'choice ' || choice, count(*) FROM j GROUP BY choice UNION ALL SELECT 'kind ' || kind, count(*) FROM j GROUP BY kind
               UNION ALL SELECT 'responses ' || model, count(*) FROM resp GROUP BY model
               UNION ALL SELECT 'load min', min(n) FROM load UNION ALL SELECT 'load max', max(n) FROM load""",
            "load AS (SELECT a, count(j.id) AS n FROM (SELECT 'ann-' || lpad(i::VARCHAR, 2, '0') AS a FROM range(1, 13) t(i)) LEFT JOIN j ON annotator_id = a GROUP BY a)",
        ),
        "integrity_violations": _sql(_BREACHES, _JUDGED.format("(SELECT *, 's-' || annotator_id AS session_id, CASE WHEN kind = 'control' THEN before END AS repeat_of FROM j)")),
        "integrity_violations_planted": _sql(
            _BREACHES,
            """planted AS (
              SELECT CASE seq % 500 WHEN 6 THEN 'bad id' ELSE id END AS id, CASE seq % 500 WHEN 3 THEN 's-none' ELSE 's-' || annotator_id END AS session_id, annotator_id,
                     CASE seq % 500 WHEN 5 THEN 'p0' ELSE prompt_id END AS prompt_id, l, CASE seq % 500 WHEN 2 THEN l ELSE r END AS r, CASE seq % 500 WHEN 1 THEN 'both' ELSE choice END AS choice,
                     kind, CASE WHEN seq % 500 = 4 THEN id WHEN kind = 'control' THEN before END AS repeat_of FROM j), """
            + _JUDGED.format("planted"),
        ),
    }
