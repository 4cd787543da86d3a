"""DuckDB oracle SQL: an independent, brute-force formulation of every query.

The same driver tables are pre-registered as views.  The attempts binding,
dense timelines and plain (unblocked) windows are spelled out directly;
the Spark side uses semi-dense spines, blocked prefix scans and one-scan
sweeps, so agreement checks the optimisations as well as the semantics.
"""

from __future__ import annotations

from routewise import constants as C

ROUTES_VALUES = ", ".join(
    f"('{r[0]}', {r[1]}::DOUBLE, {r[2]}, {r[3]}::DOUBLE, {float(r[6])}::DOUBLE, {C.ROUTE_WEIGHTS[r[0]]}::DOUBLE)"
    for r in C.ROUTES)

ELIG_VALUES = ", ".join(
    f"('{pm}', '{net}', '{r[0]}', {i})" for i, r in enumerate(C.ROUTES) for pm in r[4] for net in r[5])

BASE_CTES = f"""
e AS (SELECT event_id txn_id, ts, CAST(floor((epoch(ts)-1704067200)/3600) AS BIGINT) tick,
 greatest(10.0::DOUBLE, least(round(value*20,2), 50000.0::DOUBLE)) amount,
 (['HDFC','ICICI','SBI','Axis','Kotak','BOB'])[CAST(user_id%6+1 AS INT)] bank,
 CASE WHEN event_id%2=0 THEN 'CARD' ELSE 'UPI' END payment_method,
 CASE WHEN event_id%2=1 THEN 'UPI' WHEN (event_id // 2)%3=0 THEN 'Visa' WHEN (event_id // 2)%3=1 THEN 'Mastercard' ELSE 'Rupay' END network,
 (['Food','Shopping','Travel','Electronics','Fuel','Healthcare'])[CAST((user_id // 6)%6+1 AS INT)] merchant,
 (['Android','iOS','Web'])[CAST(user_id%3+1 AS INT)] device,
 CAST(event_type<>'error' AS INT) success, CAST(json_extract_string(props,'$.k') AS DOUBLE)+1 latency_ms, (event_id*7919)%1000 u FROM events),
attempts AS (SELECT txn_id, ts, tick, amount, bank, network, payment_method, merchant, device,
 CASE WHEN amount<1000 THEN 'LOW' WHEN amount<5000 THEN 'MEDIUM' ELSE 'HIGH' END risk,
 CASE WHEN network='Mastercard' THEN CASE WHEN u*75<35000 THEN 'R1' WHEN u*75<60000 THEN 'R3' ELSE 'R4' END
 WHEN network='Rupay' THEN CASE WHEN u*65<25000 THEN 'R2' WHEN u*65<50000 THEN 'R3' ELSE 'R4' END
 ELSE CASE WHEN u<350 THEN 'R1' WHEN u<600 THEN 'R2' WHEN u<850 THEN 'R3' ELSE 'R4' END END route_id, success, latency_ms FROM e),
routes(route_id, base_success_rate, base_latency_ms, route_cost_percent, base_capacity_tps, route_weight) AS (VALUES {ROUTES_VALUES}),
elig(payment_method, network, route_id, route_order) AS (VALUES {ELIG_VALUES}),
bounds AS (SELECT max(tick)+1 AS total_ticks, CAST(floor((max(tick)+1)*{C.TRAIN_FRACTION}) AS BIGINT) AS train_ticks FROM attempts),
gtot AS (SELECT tick, count(*) AS n FROM attempts GROUP BY tick),
rcell AS (SELECT route_id, tick, count(*) AS request_count, CAST(sum(success) AS BIGINT) AS success_count,
  sum(latency_ms) AS latency_sum, count(*) - sum(success) AS failure_count FROM attempts GROUP BY route_id, tick),
rgrid AS (SELECT r.route_id, t.tick FROM routes r CROSS JOIN (SELECT unnest(range(total_ticks)) AS tick FROM bounds) t),
rdense AS (SELECT g.route_id, g.tick, coalesce(c.request_count,0) n, coalesce(c.success_count,0) k,
  coalesce(c.latency_sum,0) lat, c.request_count IS NOT NULL AS active FROM rgrid g LEFT JOIN rcell c USING (route_id, tick)),
rwin AS (SELECT route_id, tick, n, k, lat, active,
  sum(n) OVER w5 n5, sum(k) OVER w5 k5, sum(lat) OVER w5 l5, sum(n) OVER w15 n15, sum(k) OVER w15 k15,
  sum(n) OVER w2 n2, sum(n) OVER w1 n1
  FROM rdense WINDOW w5 AS (PARTITION BY route_id ORDER BY tick RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w15 AS (PARTITION BY route_id ORDER BY tick RANGE BETWEEN 15 PRECEDING AND 1 PRECEDING),
  w2 AS (PARTITION BY route_id ORDER BY tick RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING),
  w1 AS (PARTITION BY route_id ORDER BY tick RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)),
rrate AS (SELECT *, CASE WHEN n5>0 THEN k5/n5 END AS route_success_rate_5m, CASE WHEN n15>0 THEN k15/n15 END AS route_success_rate_15m,
  CASE WHEN n5>0 THEN l5/n5 END AS route_avg_latency_5m, CAST(coalesce(n2,0) AS DOUBLE) AS route_current_load,
  CAST(coalesce(n1,0) AS DOUBLE) AS route_requests_1m FROM rwin),
rfeat AS (SELECT r.*,
  CASE WHEN route_success_rate_5m < {C.FLAG_DOWN_THRESHOLD} THEN 1.0 ELSE 0.0 END::DOUBLE AS route_flagged_down,
  coalesce(CAST(r.tick - max(CASE WHEN route_success_rate_5m < {C.FLAG_DOWN_THRESHOLD} THEN r.tick END) OVER
    (PARTITION BY route_id ORDER BY r.tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 9999.0) AS time_since_last_failure,
  coalesce(g.n, 0) / 3600.0 AS system_tps
  FROM rrate r LEFT JOIN gtot g ON g.tick = r.tick - 1),
rlive AS (SELECT f.*, f.system_tps * ro.route_weight / ro.base_capacity_tps AS route_utilization,
  CASE WHEN route_success_rate_5m = 0 THEN 'OUTAGE' WHEN route_success_rate_5m < {C.FLAG_DOWN_THRESHOLD} THEN 'DEGRADED' ELSE 'HEALTHY' END AS health_label,
  ro.base_capacity_tps * CASE WHEN route_success_rate_5m = 0 THEN 0.0 WHEN route_success_rate_5m < {C.FLAG_DOWN_THRESHOLD} THEN 0.6 ELSE 1.0 END::DOUBLE AS route_effective_capacity_tps
  FROM rfeat f JOIN routes ro USING (route_id)),
r1m AS (SELECT route_id, tick, lag(failure_count) OVER w / lag(request_count) OVER w AS route_failure_rate_1m
  FROM rcell WINDOW w AS (PARTITION BY route_id ORDER BY tick)),
base AS (SELECT route_id, avg(success) AS route_base_success_rate, avg(latency_ms) AS route_base_latency_ms
  FROM attempts WHERE tick < (SELECT train_ticks FROM bounds) AND route_id IN (SELECT route_id FROM routes) GROUP BY route_id),
overall AS (SELECT avg(route_base_success_rate) AS prior FROM base),
brcell AS (SELECT bank, route_id, tick, count(*) n, sum(success) k FROM attempts GROUP BY bank, route_id, tick),
brfeat AS (SELECT b.bank, b.route_id, b.tick,
  (coalesce(sum(k) OVER w, 0) + {C.BANK_ROUTE_SHRINK_K} * coalesce(base.route_base_success_rate, (SELECT prior FROM overall)))
  / (coalesce(sum(n) OVER w, 0) + {C.BANK_ROUTE_SHRINK_K}) AS bank_route_success_rate_15m
  FROM brcell b LEFT JOIN base USING (route_id)
  WINDOW w AS (PARTITION BY b.bank, b.route_id ORDER BY b.tick RANGE BETWEEN 15 PRECEDING AND 1 PRECEDING)),
bcell AS (SELECT bank, tick, count(*) n, count(*) - sum(success) f FROM attempts GROUP BY bank, tick),
bfeat AS (SELECT bank, tick, CASE WHEN sum(n) OVER w > 0 THEN sum(f) OVER w / sum(n) OVER w END AS bank_failure_rate_5m
  FROM bcell WINDOW w AS (PARTITION BY bank ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
ncell AS (SELECT network, tick, count(*) n, count(*) - sum(success) f FROM attempts GROUP BY network, tick),
nfeat AS (SELECT network, tick, CASE WHEN sum(n) OVER w > 0 THEN sum(f) OVER w / sum(n) OVER w END AS network_failure_rate_5m
  FROM ncell WINDOW w AS (PARTITION BY network ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
txnf AS (SELECT txn_id,
  coalesce(CAST(tick - last_value(CASE WHEN success=1 THEN tick END IGNORE NULLS) OVER
    (PARTITION BY bank, route_id ORDER BY txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 9999.0)
    AS time_since_last_bank_route_success,
  CASE WHEN count(*) OVER wb > 0 THEN amount / (sum(amount) OVER wb / count(*) OVER wb) END AS amount_to_bank_avg_ratio
  FROM attempts WINDOW wb AS (PARTITION BY bank ORDER BY txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ft AS (SELECT a.txn_id, a.tick, (a.tick*60 // 1440) % 7 AS day_in_week, (a.tick*60 % 1440) // 60 AS hour_of_day,
  a.amount, a.bank, a.network, a.payment_method, a.merchant, a.device, a.risk, a.route_id,
  base.route_base_success_rate, base.route_base_latency_ms, ro.route_cost_percent,
  l.route_success_rate_5m, l.route_success_rate_15m, l.route_avg_latency_5m, l.route_current_load, l.route_requests_1m,
  l.time_since_last_failure, l.route_flagged_down, l.route_utilization, l.route_effective_capacity_tps, l.system_tps,
  br.bank_route_success_rate_15m, a.success,
  CASE WHEN a.tick < (SELECT train_ticks FROM bounds) THEN 'train' ELSE 'test' END AS dataset_split
  FROM attempts a LEFT JOIN rlive l USING (route_id, tick) LEFT JOIN brfeat br USING (bank, route_id, tick)
  LEFT JOIN base USING (route_id) LEFT JOIN routes ro USING (route_id)),
fe AS MATERIALIZED (SELECT ft.*,
  1.0 - route_success_rate_5m AS route_failure_rate_5m, 1.0 - route_success_rate_15m AS route_failure_rate_15m,
  route_base_success_rate - route_success_rate_5m AS route_success_drop_5m,
  route_base_success_rate - route_success_rate_15m AS route_success_drop_15m,
  route_avg_latency_5m / (route_base_latency_ms + 1e-6) AS route_latency_ratio,
  bank_route_success_rate_15m - route_success_rate_15m AS bank_route_gap,
  route_utilization * (1.0 - route_success_rate_15m) AS route_stress,
  bf.bank_failure_rate_5m, nf.network_failure_rate_5m, r1.route_failure_rate_1m,
  tx.time_since_last_bank_route_success, tx.amount_to_bank_avg_ratio
  FROM ft LEFT JOIN bfeat bf USING (bank, tick) LEFT JOIN nfeat nf USING (network, tick)
  LEFT JOIN r1m r1 USING (route_id, tick) LEFT JOIN txnf tx USING (txn_id))
"""


def with_base(body: str) -> str:
    return "WITH " + BASE_CTES.strip() + "\n" + body.strip()


CAND_CTES = """
, cand AS (SELECT f.txn_id, f.tick, f.day_in_week, f.hour_of_day, f.amount, f.bank, f.network, f.payment_method,
  f.merchant, f.device, f.risk, f.bank_failure_rate_5m, f.network_failure_rate_5m, f.amount_to_bank_avg_ratio,
  f.route_id AS actual_route_id, f.success AS actual_success, el.route_id, el.route_order
  FROM fe f JOIN elig el USING (payment_method, network) WHERE f.dataset_split = 'test'),
cbr AS (SELECT x.txn_id, x.route_id,
  (coalesce(sum(c.k) FILTER (WHERE c.tick >= x.tick - 15), 0) + 10 * coalesce(b.route_base_success_rate, o.prior))
  / (coalesce(sum(c.n) FILTER (WHERE c.tick >= x.tick - 15), 0) + 10) AS bank_route_success_rate_15m,
  coalesce(CAST(x.tick - max(c.tick) FILTER (WHERE c.k > 0) AS DOUBLE), 9999.0) AS time_since_last_bank_route_success
  FROM cand x LEFT JOIN brcell c ON c.bank = x.bank AND c.route_id = x.route_id AND c.tick < x.tick
  LEFT JOIN base b ON b.route_id = x.route_id CROSS JOIN overall o
  GROUP BY x.txn_id, x.route_id, x.tick, b.route_base_success_rate, o.prior),
c1m AS (SELECT x.txn_id, x.route_id, arg_max(c.failure_count / c.request_count, c.tick) AS route_failure_rate_1m
  FROM cand x LEFT JOIN rcell c ON c.route_id = x.route_id AND c.tick < x.tick GROUP BY x.txn_id, x.route_id),
candf AS (SELECT x.*, base.route_base_success_rate, base.route_base_latency_ms, ro.route_cost_percent,
  l.route_success_rate_5m, l.route_success_rate_15m, l.route_avg_latency_5m, l.route_current_load, l.route_requests_1m,
  l.time_since_last_failure, l.route_flagged_down, l.route_utilization, l.route_effective_capacity_tps, l.system_tps,
  cbr.bank_route_success_rate_15m, c1m.route_failure_rate_1m, cbr.time_since_last_bank_route_success
  FROM cand x JOIN rlive l USING (route_id, tick) LEFT JOIN cbr USING (txn_id, route_id)
  LEFT JOIN c1m USING (txn_id, route_id) LEFT JOIN base USING (route_id) JOIN routes ro USING (route_id)),
cands AS MATERIALIZED (SELECT *, 1.0 - route_success_rate_5m AS route_failure_rate_5m, 1.0 - route_success_rate_15m AS route_failure_rate_15m,
  route_base_success_rate - route_success_rate_5m AS route_success_drop_5m,
  route_base_success_rate - route_success_rate_15m AS route_success_drop_15m,
  route_avg_latency_5m / (route_base_latency_ms + 1e-6) AS route_latency_ratio,
  bank_route_success_rate_15m - route_success_rate_15m AS bank_route_gap,
  route_utilization * (1.0 - route_success_rate_15m) AS route_stress,
  bank_route_success_rate_15m AS p, route_success_rate_5m AS outcome_proxy FROM candf),
argmax AS (SELECT txn_id, route_id, p FROM (SELECT txn_id, route_id, p,
  row_number() OVER (PARTITION BY txn_id ORDER BY p DESC, route_order) AS rn FROM cands) WHERE rn = 1),
rr_in AS MATERIALIZED (SELECT txn_id, CAST(sum(1 << route_order) AS INT) AS mask, row_number() OVER (ORDER BY txn_id) AS i
  FROM cands GROUP BY txn_id),
rr AS (WITH RECURSIVE walk(i, txn_id, pick, rot) AS (
    SELECT 0::BIGINT, NULL::BIGINT, NULL::INT, 0::INT
    UNION ALL
    SELECT x.i, x.txn_id, CASE WHEN (x.mask >> ((w.rot + 0) % 4)) & 1 = 1 THEN (w.rot + 0) % 4 WHEN (x.mask >> ((w.rot + 1) % 4)) & 1 = 1 THEN (w.rot + 1) % 4 WHEN (x.mask >> ((w.rot + 2) % 4)) & 1 = 1 THEN (w.rot + 2) % 4 WHEN (x.mask >> ((w.rot + 3) % 4)) & 1 = 1 THEN (w.rot + 3) % 4 END, CASE WHEN CASE WHEN (x.mask >> ((w.rot + 0) % 4)) & 1 = 1 THEN (w.rot + 0) % 4 WHEN (x.mask >> ((w.rot + 1) % 4)) & 1 = 1 THEN (w.rot + 1) % 4 WHEN (x.mask >> ((w.rot + 2) % 4)) & 1 = 1 THEN (w.rot + 2) % 4 WHEN (x.mask >> ((w.rot + 3) % 4)) & 1 = 1 THEN (w.rot + 3) % 4 END IS NULL THEN w.rot ELSE (CASE WHEN (x.mask >> ((w.rot + 0) % 4)) & 1 = 1 THEN (w.rot + 0) % 4 WHEN (x.mask >> ((w.rot + 1) % 4)) & 1 = 1 THEN (w.rot + 1) % 4 WHEN (x.mask >> ((w.rot + 2) % 4)) & 1 = 1 THEN (w.rot + 2) % 4 WHEN (x.mask >> ((w.rot + 3) % 4)) & 1 = 1 THEN (w.rot + 3) % 4 END + 1) % 4 END
    FROM walk w JOIN rr_in x ON x.i = w.i + 1)
  SELECT txn_id, (['R1','R2','R3','R4'])[pick + 1] AS route_id FROM walk WHERE i > 0 AND pick IS NOT NULL),
wsplit_dim AS (SELECT payment_method, network, route_id, route_order,
  (sum(w) OVER (PARTITION BY payment_method, network ORDER BY route_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w)
   / sum(w) OVER (PARTITION BY payment_method, network) AS lo,
  sum(w) OVER (PARTITION BY payment_method, network ORDER BY route_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
   / sum(w) OVER (PARTITION BY payment_method, network) AS hi
  FROM (SELECT el.*, ro.route_weight AS w FROM elig el JOIN routes ro USING (route_id))),
tx AS (SELECT DISTINCT txn_id, payment_method, network, actual_success FROM cand),
wsplit AS (SELECT t.txn_id, d.route_id FROM tx t JOIN wsplit_dim d USING (payment_method, network)
  WHERE ((t.txn_id * 104729 + 12345) % 10007) / 10007.0 >= d.lo
    AND (((t.txn_id * 104729 + 12345) % 10007) / 10007.0 < d.hi OR d.hi >= 1.0 - 1e-12)),
pol AS (
  SELECT 'actual' AS policy, avg(actual_success) AS success_rate, count(*) AS n_txn FROM tx
  UNION ALL SELECT 'round_robin', avg(c.outcome_proxy), count(*) FROM rr JOIN cands c USING (txn_id, route_id)
  UNION ALL SELECT 'model_argmax', avg(c.outcome_proxy), count(*) FROM argmax JOIN cands c USING (txn_id, route_id)
  UNION ALL SELECT 'weighted_split', avg(c.outcome_proxy), count(*) FROM wsplit JOIN cands c USING (txn_id, route_id))
"""


def with_cands(body: str) -> str:
    return "WITH " + BASE_CTES.strip() + "\n" + CAND_CTES.strip() + "\n" + body.strip()


def _thr_values(ts) -> str:
    return ", ".join(f"({j}, {float(t)!r}::DOUBLE)" for j, t in enumerate(sorted(ts)))


def eval_ctes() -> str:
    from routewise.operators.evaluate import cost_sweep_thresholds
    mults = ", ".join(f"({float(m)!r}::DOUBLE)" for m in C.COST_MULTIPLIERS)
    return f"""
, pos AS (SELECT txn_id, row_number() OVER (ORDER BY tick, txn_id) - 1 AS position FROM fe WHERE dataset_split = 'train'),
split AS (SELECT fe.*, CASE WHEN fe.dataset_split = 'test' THEN 'test'
    WHEN pos.position < CAST(floor((SELECT count(*) FROM pos) * 0.8) AS BIGINT) THEN 'train' ELSE 'validation' END AS split3,
  bank_route_success_rate_15m AS p FROM fe LEFT JOIN pos USING (txn_id)),
trn AS (SELECT * FROM split WHERE split3 = 'train'),
val AS (SELECT * FROM split WHERE split3 = 'validation'),
tst AS (SELECT * FROM split WHERE split3 = 'test'),
thr13(j, threshold) AS (VALUES {_thr_values(C.ANALYSIS_THRESHOLDS)}),
thr27(j, threshold) AS (VALUES {_thr_values(cost_sweep_thresholds())}),
mults(mult) AS (VALUES {mults}),
sw AS (SELECT m.mult, t.threshold,
  sum(CASE WHEN success = 0 AND 1.0 - p >= t.threshold THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN success = 1 AND 1.0 - p >= t.threshold THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN success = 1 AND NOT (1.0 - p >= t.threshold) THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN success = 0 AND NOT (1.0 - p >= t.threshold) THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN success = 0 AND NOT (1.0 - p >= t.threshold) THEN 50.0 * m.mult + amount * 0.02 * m.mult
           WHEN success = 1 AND 1.0 - p >= t.threshold THEN amount * route_cost_percent / 100.0
           WHEN success = 1 THEN -(amount * route_cost_percent / 100.0) ELSE 0.0 END) AS total_cost
  FROM val CROSS JOIN thr27 t CROSS JOIN mults m GROUP BY m.mult, t.threshold),
swm AS (SELECT mult, threshold, total_cost, total_cost / (tp + fp + tn + fn) AS cost_per_txn,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS failure_precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS failure_recall,
  (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp + fp AS predicted_failures FROM sw),
swf AS (SELECT *, CASE WHEN failure_precision + failure_recall > 0
  THEN 2 * failure_precision * failure_recall / (failure_precision + failure_recall) ELSE 0.0 END AS failure_f1 FROM swm),
prc AS (SELECT threshold, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps FROM
  (SELECT 1.0 - p AS threshold, sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) AS pos,
          sum(CASE WHEN success = 1 THEN 1 ELSE 0 END) AS neg FROM val GROUP BY 1)
  WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pr AS (SELECT threshold, CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0 END AS precision,
  tps / (SELECT sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) FROM val) AS recall FROM prc)
"""


def with_eval(body: str) -> str:
    return "WITH " + BASE_CTES.strip() + "\n" + eval_ctes().strip() + "\n" + body.strip()
