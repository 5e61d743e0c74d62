"""DuckDB oracle SQL for the registered queries.

Each oracle is plain SQL over the driver's tables with the domain views
inlined as CTEs.  The views mirror ``hydrolake.sources.fixtures``; the
band texts are generated from ``hydrolake.constants`` (the fixed values),
everything else is written out by hand.
"""

from __future__ import annotations

from hydrolake import constants as K


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def RN(x: str, d: int = 2) -> str:
    return f"(round_even(({x})*1e{d}, 0)/1e{d})"


def PYR(x: str) -> str:
    """The language's round(x, 2), by the error of the product: 100 x = 64 x + 32 x + 4 x, each term exact."""
    p = f"(({x})*100.0::DOUBLE)"
    e = f"(((({x})*64.0::DOUBLE - {p}) + ({x})*32.0::DOUBLE) + ({x})*4.0::DOUBLE)"
    tie = f"{p} - floor({p}) = 0.5"
    return (f"(CASE WHEN {tie} AND {e} > 0 THEN ceil({p}) WHEN {tie} AND {e} < 0 THEN floor({p}) "
            f"ELSE round_even({p}, 0) END / 100.0::DOUBLE)")


def case_band(expr: str, edges, outs, nan_last: bool = True) -> str:
    parts = [f"WHEN ({expr}) IS NULL THEN NULL"]
    if nan_last:
        parts.append(f"WHEN isnan({expr}) THEN {outs[-1]}")
    for e, o in zip(edges, outs):
        if e is None:
            parts.append(f"ELSE {o}")
        else:
            parts.append(f"WHEN ({expr}) >= {e!r} THEN {o}")
    return "CASE " + " ".join(parts) + " END"


def quality_band_sql(expr: str, idx: int) -> str:
    return case_band(expr, [b[0] for b in K.QUALITY_BANDS], [q(b[idx]) for b in K.QUALITY_BANDS])


def perf_band_sql(expr: str, idx: int) -> str:
    return case_band(expr, [b[0] for b in K.PERFORMANCE_BANDS], [q(b[idx]) for b in K.PERFORMANCE_BANDS])


def perf_interp_sql(eff: str, deficit: str, lpcd: str) -> str:
    outs = []
    for b in K.PERFORMANCE_BANDS:
        t = b[3]
        pieces = []
        rest = t
        while rest:
            i = rest.find("{")
            if i < 0:
                pieces.append(q(rest))
                break
            j = rest.index("}", i)
            if i:
                pieces.append(q(rest[:i]))
            name = rest[i + 1 : j]
            col = {"eff": eff, "deficit": deficit, "lpcd": lpcd}[name]
            pieces.append(f"CAST({col} AS VARCHAR)")
            rest = rest[j + 1 :]
        outs.append("(" + " || ".join(pieces) + ")")
    return case_band(eff, [b[0] for b in K.PERFORMANCE_BANDS], outs)


def MC(x: str) -> str:
    return f"printf('MC%03d', ({x})+1)"


def HUB(x: str) -> str:
    return f"printf('HUB%04d', ({x})+1)"


def subscores_sql() -> dict[str, str]:
    return {
        "Temperature": "greatest(0.0, 100.0 - abs(Temperature - 25.0) * 4.0)",
        "pH": "greatest(0.0, 100.0 - abs(pH - 7.0) * 10.0)",
        "Conductivity": "greatest(0.0, 100.0 - Conductivity / 100.0)",
        "BOD": "greatest(0.0, 100.0 - BOD * 10.0)",
        "Faecal_Coliform": "greatest(0.0, 100.0 - Faecal_Coliform / 10.0)",
        "Total_Coliform": "greatest(0.0, 100.0 - Total_Coliform / 10.0)",
        "Nitrate_N": "greatest(0.0, 100.0 - Nitrate_N * 5.0)",
    }


def rule_wqi_sql() -> str:
    s = subscores_sql()
    terms = [f"({s[p]}) * {K.WEIGHTS[p]!r}" for p in K.PARAMS]
    return PYR(" + ".join(terms))


# -- views --------------------------------------------------------------------
VIEWS: dict[str, str] = {}

VIEWS["municipal_data"] = f"""
SELECT {MC('n_nationkey')} AS MC_Code, n_name AS MC_Name, printf('D%02d', n_regionkey+1) AS Division_Code,
  CAST(10000*k AS BIGINT) AS Population, a/100.0 AS Total_Demand_MLD,
  (a/100.0)*((n_nationkey+20)/40.0) AS Current_Supply_MLD
FROM nation JOIN (SELECT c_nationkey, count(*) AS k, sum(abs(c_acctbal)) AS a FROM customer GROUP BY c_nationkey) z
  ON n_nationkey = c_nationkey"""

VIEWS["hub_table"] = f"SELECT {HUB('s_suppkey')} AS Hub_ID, s_name AS Hub_Name FROM supplier"
VIEWS["mc_hub_mapping"] = f"SELECT {MC('s_nationkey')} AS MC_Code, {HUB('s_suppkey')} AS Hub_ID FROM supplier"
VIEWS["division_fixture"] = (
    "SELECT printf('D%02d', r_regionkey+1) AS Division_Code, r_name AS name FROM region WHERE r_regionkey < 4"
)
VIEWS["principals"] = (
    f"SELECT 'user' || CAST(n_nationkey AS VARCHAR) AS Username, {MC('n_nationkey')} AS MC_Code "
    "FROM nation WHERE n_nationkey % 3 = 0"
)

VIEWS["quality_readings"] = f"""
SELECT l_orderkey, l_linenumber, {MC('s_nationkey')} AS MC_Code, {HUB('l_suppkey')} AS Hub_ID,
  12.0 + l_quantity*0.6 AS Temperature_Min, 14.0 + l_quantity*0.6 AS Temperature_Max,
  5.0 + l_discount*40.0 AS pH_Min, 5.4 + l_discount*40.0 AS pH_Max,
  l_extendedprice/20.0 AS Conductivity_Min, l_extendedprice/10.0 AS Conductivity_Max,
  l_tax*280.0 AS BOD_Min, l_tax*320.0 AS BOD_Max,
  l_extendedprice/25.0 AS Faecal_Coliform_Min, l_extendedprice/15.0 AS Faecal_Coliform_Max,
  l_extendedprice/30.0 AS Total_Coliform_Min, l_extendedprice/20.0 AS Total_Coliform_Max,
  l_quantity*0.3 AS Nitrate_N_Min, l_quantity*0.5 AS Nitrate_N_Max,
  l_shipdate + INTERVAL 22 YEAR AS Created_At
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""

_MID = ",\n  ".join(
    f"(({p}_Min + {p}_Max) / 2.0) AS {p}_mid" for p in K.READING_PARAMS
)
_CAP = ",\n  ".join(
    f"least({p}_mid, {K.CAPS[p]!r}) AS {p}" for p in K.READING_PARAMS
)

VIEWS["quality_mid"] = f"""
SELECT l_orderkey, l_linenumber, MC_Code, Hub_ID, Created_At,
  {_MID}
FROM quality_readings"""

VIEWS["quality_capped"] = f"""
SELECT l_orderkey, l_linenumber, MC_Code, Hub_ID, Created_At,
  {_CAP}
FROM quality_mid"""

VIEWS["quality_scored"] = f"""
SELECT *, {rule_wqi_sql()} AS Rule_WQI FROM quality_capped"""

VIEWS["quality_records"] = f"""
SELECT *, {quality_band_sql('WQI', 1)} AS Category FROM (
SELECT l_orderkey, l_linenumber, MC_Code, Hub_ID, CASE WHEN l_orderkey % 89 <> 0 THEN Temperature END AS Temperature,
  pH, BOD, Faecal_Coliform, Total_Coliform, Nitrate_N AS Nitrate, Conductivity,
  CASE WHEN (l_orderkey+l_linenumber)%97=0 THEN NULL ELSE Rule_WQI END AS WQI,
  CASE WHEN (l_orderkey*7+l_linenumber)%50=0 THEN {q(K.ANOMALY)} ELSE {q(K.NORMAL)} END AS Anomaly_Status,
  CASE WHEN (CAST(substr(Hub_ID, 4) AS INT) + year(Created_At)) % 7 = 3 THEN Created_At + INTERVAL 1 YEAR ELSE Created_At END AS Created_At,
  CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS Used_For_Training
FROM quality_scored) z"""

VIEWS["distribution_inputs"] = f"""
SELECT o_orderkey, {MC('c_nationkey')} AS MC_Code, {HUB('o_custkey % 40')} AS Hub_ID,
  o_totalprice/1000.0 AS Total_Demand_MLD,
  (o_totalprice/1000.0)*(0.3+(o_orderkey%80)/100.0) AS Current_Supply_MLD,
  CAST(100000+o_custkey*100 AS BIGINT) AS Population,
  {RN('100.0*(0.3+(o_orderkey%80)/100.0)')} AS eff_pred,
  CASE WHEN (o_orderkey%80)<40 THEN 1 ELSE 0 END AS risk_pred,
  o_orderdate + INTERVAL 22 YEAR AS Created_At
FROM orders JOIN customer ON o_custkey = c_custkey"""

VIEWS["distribution_scored0"] = f"""
SELECT *,
  {RN('eff_pred')} AS Predicted_Supply_Efficiency,
  (risk_pred <> 0) AS Critical_Risk_B,
  {RN('Total_Demand_MLD - Current_Supply_MLD')} AS Deficit_MLD,
  {RN('(Current_Supply_MLD*1000000.0)/NULLIF(Population*1000, 0)')} AS PerCapita_LPCD,
  CASE WHEN risk_pred = 1 THEN {q(K.STATUS_CRITICAL)} ELSE {q(K.STATUS_STABLE)} END AS Status,
  CASE WHEN eff_pred < {K.PUMPING_CUT!r} THEN {q(K.ACTION_INCREASE)}
       WHEN risk_pred = 1 THEN {q(K.ACTION_ROTATE)} ELSE {q(K.ACTION_MAINTAIN)} END AS Operating_Action
FROM distribution_inputs"""

VIEWS["distribution_scored"] = f"""
SELECT *,
  {perf_band_sql('Predicted_Supply_Efficiency', 1)} AS Performance,
  {perf_band_sql('Predicted_Supply_Efficiency', 2)} AS Emoji_Status,
  {perf_interp_sql('Predicted_Supply_Efficiency', 'Deficit_MLD', 'PerCapita_LPCD')} AS Interpretation,
  {perf_band_sql('Predicted_Supply_Efficiency', 4)} ||
    CASE WHEN Critical_Risk_B THEN {q(K.RISK_ADVICE_CRITICAL)} ELSE {q(K.RISK_ADVICE_STABLE)} END AS Advice,
  CASE WHEN Critical_Risk_B THEN {q(K.RISK_LABEL_CRITICAL)} ELSE {q(K.RISK_LABEL_STABLE)} END AS Risk_Label,
  {perf_band_sql('Predicted_Supply_Efficiency', 5)} AS Performance_Grade
FROM distribution_scored0"""

VIEWS["distribution_records"] = """
SELECT o_orderkey, MC_Code, Hub_ID, Total_Demand_MLD, Current_Supply_MLD, Population, Deficit_MLD, PerCapita_LPCD,
  Predicted_Supply_Efficiency, CAST(Critical_Risk_B AS INT) AS Critical_Risk, Advice AS Recommended_Action, Created_At
FROM distribution_scored"""

VIEWS["raw_readings"] = f"""
SELECT event_id, {MC('user_id % 25')} AS MC_Code,
  CASE WHEN event_id%211=0 THEN NULL ELSE {HUB('user_id')} END AS Hub_ID,
  CASE WHEN event_id%53=0 THEN 'bad' WHEN event_id%47=0 THEN CAST(value AS VARCHAR) || 'mg'
       ELSE CAST(value AS VARCHAR) END AS BOD_Text,
  CASE WHEN event_id%59=0 THEN 'not-a-date' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS Created_Text
FROM events"""

# dependency order of the views
VIEW_DEPS = {
    "quality_mid": ["quality_readings"],
    "quality_capped": ["quality_mid"],
    "quality_scored": ["quality_capped"],
    "quality_records": ["quality_scored"],
    "distribution_scored0": ["distribution_inputs"],
    "distribution_scored": ["distribution_scored0"],
    "distribution_records": ["distribution_scored"],
}


def with_views(sql: str, *views: str, ctes: str = "") -> str:
    """Prefix ``sql`` with the view CTEs it needs (and their dependencies), then ``ctes``."""
    order: list[str] = []

    def add(v: str) -> None:
        for d in VIEW_DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in order]
    if ctes.strip():
        parts.append(ctes.strip())
    return f"WITH {',\n'.join(parts)}\n{sql}" if parts else sql


# -- oracles ------------------------------------------------------------------
ANOM = f"CASE WHEN Anomaly_Status = {q(K.ANOMALY)} THEN 1 ELSE 0 END"
ML_WQI = "(((l_orderkey*13 + l_linenumber*7) % 10000) / 100.0)"
ANOM_PRED = "CASE WHEN (l_orderkey*7 + l_linenumber) % 50 = 0 THEN -1 ELSE 1 END"


def trend_sql(delta: str, step: float, none_label: str) -> str:
    return (f"CASE WHEN ({delta}) IS NULL THEN {q(none_label)} WHEN ({delta}) > {step!r} THEN {q(K.IMPROVING)} "
            f"WHEN ({delta}) < {-step!r} THEN {q(K.DEGRADING)} ELSE {q(K.STABLE)} END")


def dzr(x: str) -> str:
    """round(x, 2) if x else 0."""
    return f"CASE WHEN ({x}) IS NULL OR ({x}) = 0 THEN 0.0 ELSE {RN(x)} END"


ORACLES: dict[str, str] = {}


# ---------------------------------------------------------------- flagship --
YQ_AGG = f"""agg AS (SELECT MC_Code, Hub_ID, CAST(year(Created_At) AS INT) AS Year, avg(WQI) AS a, max(WQI) AS mx,
      min(WQI) AS mn, count(*) AS n, CAST(sum({ANOM}) AS BIGINT) AS an
    FROM quality_records GROUP BY MC_Code, Hub_ID, CAST(year(Created_At) AS INT))"""

ORACLES["yearly_quality_trend"] = with_views(f"""
SELECT MC_Code, Hub_ID, Year,
  CASE WHEN n IS NOT NULL THEN a ELSE 0.0 END AS Average_WQI,
  CASE WHEN n IS NOT NULL THEN mx ELSE 0.0 END AS Max_WQI,
  CASE WHEN n IS NOT NULL THEN mn ELSE 0.0 END AS Min_WQI,
  coalesce(n, 0) AS Total_Records, coalesce(an, 0) AS Anomaly_Count,
  {trend_sql(RN('a - prev'), K.YEARLY_TREND_STEP, K.NOT_AVAILABLE)} AS Trend,
  {RN('a - prev')} AS Yearly_Delta
FROM w""", "quality_records", ctes=f"""{YQ_AGG},
  keys AS (SELECT DISTINCT MC_Code, Hub_ID FROM agg),
  spine AS (SELECT MC_Code, Hub_ID, CAST(y AS INT) AS Year FROM keys, range({K.FIRST_REPORT_YEAR}, 2025) t(y)),
  grid AS (SELECT s.MC_Code, s.Hub_ID, s.Year, g.a, g.mx, g.mn, g.n, g.an FROM spine s LEFT JOIN agg g
    ON s.MC_Code = g.MC_Code AND s.Hub_ID = g.Hub_ID AND s.Year = g.Year),
  w AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY MC_Code, Hub_ID ORDER BY Year
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM grid)""")

# ------------------------------------------------------- quality projections --
_P = list(K.READING_PARAMS)
ORACLES["param_midpoints"] = with_views(
    "SELECT l_orderkey, l_linenumber, Hub_ID, " + ", ".join(f"{p}_mid AS {p}" for p in _P) + " FROM quality_mid",
    "quality_mid")
ORACLES["cap_params"] = with_views(
    "SELECT l_orderkey, l_linenumber, Hub_ID, " + ", ".join(_P) + " FROM quality_capped", "quality_capped")
ORACLES["wqi_subscores"] = with_views(
    "SELECT l_orderkey, l_linenumber, Hub_ID, "
    + ", ".join(f"{subscores_sql()[p]} AS {p}_Score" for p in K.PARAMS) + " FROM quality_capped", "quality_capped")
ORACLES["rule_wqi"] = with_views("SELECT l_orderkey, l_linenumber, Hub_ID, Rule_WQI FROM quality_scored",
                                 "quality_scored")

HYBRID_CTE = f"""hybrid AS (SELECT *, {PYR('ml_wqi*0.7::DOUBLE + Rule_WQI*0.3::DOUBLE')} AS WQI FROM
    (SELECT *, {ML_WQI} AS ml_wqi FROM quality_scored) h0)"""
CAT5_CTE = f"""cat5 AS (SELECT *, {quality_band_sql('WQI', 1)} AS Category, {quality_band_sql('WQI', 2)} AS Emoji_Status,
    {quality_band_sql('WQI', 3)} AS Interpretation, {quality_band_sql('WQI', 4)} AS Recommended_Action FROM hybrid)"""
HIT = f"((pH < {K.SAFETY_PH_BELOW!r}) OR (BOD > {K.SAFETY_BOD_ABOVE!r}) OR (Faecal_Coliform > {K.SAFETY_FC_ABOVE!r}))"
SAFE_CTE = f"""safe AS (SELECT l_orderkey, l_linenumber, Hub_ID, pH, BOD, Faecal_Coliform, ml_wqi, Rule_WQI,
    CASE WHEN {HIT} AND WQI > {K.SAFETY_WQI_CEILING!r} THEN '35' ELSE CAST(WQI AS VARCHAR) END AS WQI_Text,
    CASE WHEN {HIT} THEN least(WQI, {K.SAFETY_WQI_CEILING!r}) ELSE WQI END AS WQI,
    CASE WHEN {HIT} THEN {q(K.SAFETY_CATEGORY)} ELSE Category END AS Category,
    CASE WHEN {HIT} THEN {q(K.SAFETY_EMOJI)} ELSE Emoji_Status END AS Emoji_Status,
    CASE WHEN {HIT} THEN {q(K.SAFETY_INTERPRETATION)} ELSE Interpretation END AS Interpretation,
    CASE WHEN {HIT} THEN {q(K.SAFETY_ACTION)} ELSE Recommended_Action END AS Recommended_Action
  FROM cat5)"""
ANOM_CTE = f"""anom AS (SELECT *, {ANOM_PRED} AS anomaly_pred FROM safe),
  labelled AS (SELECT l_orderkey, l_linenumber, Hub_ID, ml_wqi, Rule_WQI, WQI, WQI_Text, Category, Interpretation,
    anomaly_pred,
    CASE WHEN anomaly_pred = -1 THEN {q(K.ANOMALY)} ELSE {q(K.NORMAL)} END AS Anomaly_Status,
    CASE WHEN anomaly_pred = -1 THEN {q(K.ANOMALY_EMOJI)} ELSE Emoji_Status END AS Emoji_Status,
    CASE WHEN anomaly_pred = -1 THEN Recommended_Action || {q(K.ANOMALY_ACTION_SUFFIX)}
         ELSE Recommended_Action END AS Recommended_Action
  FROM anom)"""

ORACLES["hybrid_wqi"] = with_views("SELECT l_orderkey, l_linenumber, Hub_ID, Rule_WQI, ml_wqi, WQI FROM hybrid",
                                   "quality_scored", ctes=HYBRID_CTE)
ORACLES["wqi_category5"] = with_views(
    "SELECT l_orderkey, l_linenumber, WQI, Category, Emoji_Status, Interpretation, Recommended_Action FROM cat5",
    "quality_scored", ctes=HYBRID_CTE + ",\n" + CAT5_CTE)
ORACLES["wqi_category3"] = with_views(
    "SELECT l_orderkey, l_linenumber, WQI, CASE WHEN WQI IS NULL THEN NULL WHEN WQI >= 70.0 THEN 'Good' "
    "WHEN WQI >= 50.0 THEN 'Moderate' ELSE 'Poor' END AS Category3 FROM hybrid",
    "quality_scored", ctes=HYBRID_CTE)
ORACLES["safety_downgrade"] = with_views(
    "SELECT l_orderkey, l_linenumber, pH, BOD, Faecal_Coliform, WQI, WQI_Text, Category, Emoji_Status, "
    "Interpretation, Recommended_Action FROM safe",
    "quality_scored", ctes=",\n".join([HYBRID_CTE, CAT5_CTE, SAFE_CTE]))
ORACLES["anomaly_label"] = with_views(
    "SELECT l_orderkey, l_linenumber, anomaly_pred, Anomaly_Status, Emoji_Status, Recommended_Action FROM labelled",
    "quality_scored", ctes=",\n".join([HYBRID_CTE, CAT5_CTE, SAFE_CTE, ANOM_CTE]))
ORACLES["quality_summary_text"] = with_views(
    "SELECT l_orderkey, l_linenumber, Hub_ID, "
    "Emoji_Status || ' The AI predicts a WQI of ' || WQI_Text || ' (' || Category || '). ' || Interpretation || "
    "' Recommended action: ' || Recommended_Action AS AI_Summary, "
    "'✅ Record saved successfully for Hub ' || Hub_ID || '.' AS Message, "
    f"{RN('ml_wqi')} AS ML_WQI, Rule_WQI, {q(K.HYBRID_MODEL_TEXT)} AS Hybrid_Model FROM labelled",
    "quality_scored", ctes=",\n".join([HYBRID_CTE, CAT5_CTE, SAFE_CTE, ANOM_CTE]))
ORACLES["nitrate_rename"] = with_views(
    "SELECT l_orderkey, l_linenumber, Temperature_mid AS Temperature, pH_mid AS pH, BOD_mid AS BOD, "
    "Faecal_Coliform_mid AS Faecal_Coliform, Total_Coliform_mid AS Total_Coliform, Nitrate_N_mid AS Nitrate, "
    "Conductivity_mid AS Conductivity FROM quality_mid", "quality_mid")
ORACLES["unpivot_features"] = with_views(
    " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, Hub_ID, '{p}' AS Feature, {p} AS Value FROM quality_scored"
                       for p in _P), "quality_scored")

# -------------------------------------------------- distribution projections --
ORACLES["distribution_features"] = with_views(
    "SELECT o_orderkey, Hub_ID, Total_Demand_MLD - Current_Supply_MLD AS deficit, "
    "Current_Supply_MLD / NULLIF(Total_Demand_MLD, 0) * 100.0 AS efficiency, "
    "(Current_Supply_MLD * 1000000.0) / NULLIF(Population * 1000, 0) AS per_capita FROM distribution_inputs",
    "distribution_inputs")
ORACLES["operating_action"] = with_views(
    "SELECT o_orderkey, eff_pred, risk_pred, Status, Operating_Action FROM distribution_scored0",
    "distribution_scored0")
ORACLES["distribution_rounding"] = with_views(
    "SELECT o_orderkey, Predicted_Supply_Efficiency, Critical_Risk_B AS Critical_Risk, Deficit_MLD, PerCapita_LPCD "
    "FROM distribution_scored0", "distribution_scored0")
ORACLES["performance_band"] = with_views(
    "SELECT o_orderkey, Performance, Emoji_Status, Interpretation FROM distribution_scored", "distribution_scored")
ORACLES["risk_label"] = with_views("SELECT o_orderkey, Risk_Label, Advice FROM distribution_scored",
                                   "distribution_scored")
ORACLES["performance_grade"] = with_views(
    "SELECT o_orderkey, Predicted_Supply_Efficiency, Performance_Grade FROM distribution_scored",
    "distribution_scored")
ORACLES["distribution_commentary"] = with_views(
    "SELECT o_orderkey, Hub_ID, "
    "Emoji_Status || ' Hub ' || Hub_ID || ' operates at ' || CAST(Predicted_Supply_Efficiency AS VARCHAR) || "
    "'% efficiency (' || Performance_Grade || '). ' || Interpretation || ' Recommended next action: ' || Advice "
    "AS AI_Commentary, "
    "Emoji_Status || ' ' || Performance || ' performance with ' || CAST(Predicted_Supply_Efficiency AS VARCHAR) || "
    "'% efficiency. ' || Interpretation AS Summary, "
    "'✅ AI-enhanced distribution prediction saved for Hub ' || Hub_ID AS Message FROM distribution_scored",
    "distribution_scored")

YD_AGG = """yagg AS (SELECT MC_Code, Hub_ID, CAST(year(Created_At) AS INT) AS Year,
    avg(CASE WHEN isinf(Predicted_Supply_Efficiency) OR isnan(Predicted_Supply_Efficiency) THEN NULL
        ELSE Predicted_Supply_Efficiency END) AS Average_Efficiency,
    CAST(coalesce(sum(Critical_Risk), 0) AS BIGINT) AS Critical_Count
  FROM distribution_records WHERE Created_At IS NOT NULL AND Hub_ID IS NOT NULL
  GROUP BY MC_Code, Hub_ID, CAST(year(Created_At) AS INT))"""


def grade_sql(x: str) -> str:
    return (f"CASE WHEN ({x}) IS NULL THEN {q(K.GRADE_UNKNOWN)} ELSE "
            + perf_band_sql(x, 5).replace(f"WHEN ({x}) IS NULL THEN NULL ", "") + " END")


ORACLES["nullable_grade"] = with_views(
    f"SELECT MC_Code, Hub_ID, Year, {grade_sql('Average_Efficiency')} AS Performance_Grade FROM yagg",
    "distribution_records", ctes=YD_AGG)

MUNI_PRED = """mp AS (SELECT *, Current_Supply_MLD / Total_Demand_MLD * 100.0 AS eff_pred FROM municipal_data),
  mp2 AS (SELECT *, CASE WHEN eff_pred < 75.0 THEN 1 ELSE 0 END AS risk_pred FROM mp)"""
ORACLES["municipal_simulation"] = with_views(
    f"SELECT MC_Code, MC_Name, Division_Code, Population, Total_Demand_MLD, Current_Supply_MLD, "
    f"{RN('eff_pred')} AS predicted_efficiency, CAST(risk_pred AS INT) AS critical_risk, "
    f"CASE WHEN eff_pred < 70.0 THEN {q(K.ACTION_INCREASE)} WHEN risk_pred = 1 THEN {q(K.ACTION_ROTATE)} "
    f"ELSE {q(K.ACTION_MAINTAIN)} END AS recommended_action, TIMESTAMP '2024-12-31 00:00:00' AS last_updated FROM mp2",
    "municipal_data", ctes=MUNI_PRED)

# ------------------------------------------------------------------ cleaning --
ORACLES["drop_nulls_subset"] = with_views(
    "SELECT event_id, Hub_ID, BOD FROM (SELECT event_id, Hub_ID, TRY_CAST(BOD_Text AS DOUBLE) AS BOD "
    "FROM raw_readings) z WHERE Hub_ID IS NOT NULL AND BOD IS NOT NULL AND NOT isnan(BOD)", "raw_readings")
ORACLES["to_numeric_coerce"] = with_views(
    "SELECT event_id, BOD_Text, TRY_CAST(BOD_Text AS DOUBLE) AS BOD FROM raw_readings", "raw_readings")
ORACLES["to_timestamp_coerce"] = with_views(
    "SELECT event_id, Created_Text, TRY_STRPTIME(Created_Text, '%Y-%m-%d') AS Created_At FROM raw_readings",
    "raw_readings")
ORACLES["nonfinite_to_zero"] = with_views(
    "SELECT coalesce(event_id, 0) AS event_id, coalesce(Hub_ID, '0') AS Hub_ID, "
    "CASE WHEN BOD IS NULL OR isnan(BOD) OR isinf(BOD) THEN 0.0 ELSE BOD END AS BOD "
    "FROM (SELECT event_id, Hub_ID, TRY_CAST(BOD_Text AS DOUBLE) AS BOD FROM raw_readings) z", "raw_readings")
ORACLES["nonfinite_to_null"] = with_views(
    f"SELECT l_orderkey, l_linenumber, CASE WHEN isnan(WQI) OR isinf(WQI) THEN NULL ELSE {RN('WQI', 3)} END AS WQI, "
    f"CASE WHEN isnan(ratio) OR isinf(ratio) THEN NULL ELSE {RN('ratio', 3)} END AS ratio "
    "FROM (SELECT *, WQI / NULLIF(ml_wqi - 50.0, 0) AS ratio FROM hybrid) z",
    "quality_scored", ctes=HYBRID_CTE)
ORACLES["safe_num"] = with_views(
    f"SELECT event_id, CASE WHEN isnan(b) OR isinf(b) THEN NULL ELSE {RN('b', 4)} END AS BOD "
    "FROM (SELECT event_id, TRY_CAST(BOD_Text AS DOUBLE) AS b FROM raw_readings) z", "raw_readings")
ORACLES["year_of"] = with_views("SELECT o_orderkey, CAST(year(Created_At) AS INT) AS Year FROM distribution_records",
                                "distribution_records")
ORACLES["default_zero_round"] = with_views(
    f"SELECT MC_Code, {dzr('avg(Predicted_Supply_Efficiency)')} AS Average_Supply_Efficiency, "
    f"{dzr('sum(Deficit_MLD)')} AS Total_Deficit_MLD FROM distribution_records GROUP BY MC_Code",
    "distribution_records")
ORACLES["count_message"] = with_views(
    f"SELECT h.Hub_ID, coalesce(c.n, 0) AS n, CASE WHEN coalesce(c.n, 0) = 0 THEN {q(K.NO_ANOMALIES)} "
    "ELSE '⚠️ ' || CAST(c.n AS VARCHAR) || ' anomalies detected' END AS Message "
    "FROM (SELECT DISTINCT Hub_ID FROM quality_records) h LEFT JOIN "
    f"(SELECT Hub_ID, count(*) AS n FROM quality_records WHERE Anomaly_Status = {q(K.ANOMALY)} GROUP BY Hub_ID) c "
    "ON h.Hub_ID IS NOT DISTINCT FROM c.Hub_ID", "quality_records")
ORACLES["coerce_form_numbers"] = with_views(
    "SELECT event_id, BOD_Text, CASE WHEN v IS NULL OR isnan(v) OR v = 0 THEN 0.0 ELSE v END AS BOD FROM "
    "(SELECT event_id, BOD_Text, TRY_CAST(regexp_extract(BOD_Text, "
    "'^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1) AS DOUBLE) AS v FROM raw_readings) z", "raw_readings")
ORACLES["validate_readings"] = with_views(
    "SELECT event_id, MC_Code, Hub_ID, TRY_CAST(BOD_Text AS DOUBLE) AS BOD, TRY_CAST(Created_Text AS DATE) AS Created_At "
    "FROM raw_readings WHERE MC_Code IS NOT NULL AND Hub_ID IS NOT NULL AND TRY_CAST(BOD_Text AS DOUBLE) IS NOT NULL "
    "AND TRY_CAST(Created_Text AS DATE) IS NOT NULL", "raw_readings")

ORACLES["quarantine_readings"] = with_views(
    "SELECT CAST(event_id AS BIGINT) AS event_id, MC_Code, Hub_ID, BOD_Text AS BOD, Created_Text AS Created_At, "
    "concat_ws(',', CASE WHEN MC_Code IS NULL THEN 'MC_Code' END, CASE WHEN Hub_ID IS NULL THEN 'Hub_ID' END, "
    "CASE WHEN TRY_CAST(BOD_Text AS DOUBLE) IS NULL THEN 'BOD' END, "
    "CASE WHEN TRY_CAST(Created_Text AS DATE) IS NULL THEN 'Created_At' END) AS Rejected_Fields "
    "FROM raw_readings WHERE MC_Code IS NULL OR Hub_ID IS NULL OR TRY_CAST(BOD_Text AS DOUBLE) IS NULL "
    "OR TRY_CAST(Created_Text AS DATE) IS NULL", "raw_readings")

ORACLES["validate_one_pass"] = (
    ORACLES["validate_readings"].replace("AS Created_At FROM raw", "AS Created_At, CAST(NULL AS VARCHAR) AS Rejected_Fields FROM raw")
    + " UNION ALL SELECT event_id, MC_Code, Hub_ID, NULL, NULL, "
    + ORACLES["quarantine_readings"].split("Created_Text AS Created_At, ")[1])

# ------------------------------------------------------------------- filters --
ORACLES["tenant_filter"] = with_views(
    "SELECT MC_Code, Hub_ID, WQI, Anomaly_Status, Created_At FROM quality_records WHERE MC_Code = 'MC007'",
    "quality_records")
ORACLES["optional_hub_filter"] = with_views(
    "SELECT MC_Code, Hub_ID, WQI, Created_At FROM quality_records WHERE Hub_ID = 'HUB0009'", "quality_records")
ORACLES["anomaly_filter"] = with_views(
    f"SELECT MC_Code, Hub_ID, WQI, Created_At FROM quality_records WHERE Anomaly_Status = {q(K.ANOMALY)}",
    "quality_records")
ORACLES["critical_filter"] = with_views(
    "SELECT MC_Code, Hub_ID, Predicted_Supply_Efficiency, Created_At FROM distribution_records WHERE Critical_Risk = 1",
    "distribution_records")
ORACLES["temperature_not_null"] = with_views(
    "SELECT Hub_ID, Temperature, WQI FROM quality_records WHERE Temperature IS NOT NULL", "quality_records")
ORACLES["created_not_null"] = with_views(
    "SELECT event_id, Created_At FROM (SELECT event_id, TRY_STRPTIME(Created_Text, '%Y-%m-%d') AS Created_At "
    "FROM raw_readings) z WHERE Created_At IS NOT NULL", "raw_readings")
ORACLES["year_range_filter"] = with_views(
    "SELECT Hub_ID, WQI, Created_At FROM quality_records "
    "WHERE Created_At >= TIMESTAMP '2018-01-01 00:00:00' AND Created_At < TIMESTAMP '2025-01-01 00:00:00'",
    "quality_records")

# --------------------------------------------------------------------- joins --
HUBS_CTE = """hj AS (SELECT m.MC_Code, m.Hub_ID, h.Hub_Name FROM mc_hub_mapping m JOIN hub_table h ON m.Hub_ID = h.Hub_ID),
  hc AS (SELECT MC_Code, count(*) AS Total_Hubs FROM hj GROUP BY MC_Code),
  hubs AS (SELECT hj.MC_Code, hj.Hub_ID, hj.Hub_Name, hc.Total_Hubs FROM hj JOIN hc ON hj.MC_Code = hc.MC_Code)"""
ORACLES["hubs_for_mc"] = with_views("SELECT MC_Code, Hub_ID, Hub_Name, Total_Hubs FROM hubs",
                                    "mc_hub_mapping", "hub_table", ctes=HUBS_CTE)
ORACLES["tenant_scope"] = with_views(
    "SELECT MC_Code, Hub_ID, WQI, Created_At FROM quality_records WHERE MC_Code IN (SELECT p.MC_Code FROM principals p "
    "JOIN municipal_data m ON p.MC_Code = m.MC_Code)", "quality_records", "principals", "municipal_data")
ORACLES["hub_year_spine"] = with_views(
    f"SELECT MC_Code, Hub_ID, CAST(y AS INT) AS Year FROM (SELECT DISTINCT MC_Code, Hub_ID FROM quality_records) k, "
    f"range({K.FIRST_REPORT_YEAR}, 2025) t(y)", "quality_records")
LATEST_SQL = (
    "SELECT MC_Code, Hub_ID, Predicted_Supply_Efficiency, Critical_Risk, Recommended_Action, Created_At "
    "FROM distribution_records d WHERE Created_At = (SELECT max(Created_At) FROM distribution_records d2 "
    "WHERE d2.MC_Code = d.MC_Code)")
ORACLES["latest_by_subquery"] = with_views(LATEST_SQL, "distribution_records")
ORACLES["municipal_with_division"] = with_views(
    "SELECT m.Division_Code, m.MC_Code, m.MC_Name, m.Population, m.Total_Demand_MLD, m.Current_Supply_MLD, "
    "d.name AS Division_Name FROM municipal_data m LEFT JOIN division_fixture d ON m.Division_Code = d.Division_Code",
    "municipal_data", "division_fixture")
_DIV_VALUES = ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in K.DIVISIONS)
ORACLES["division_dim"] = with_views(
    "SELECT m.MC_Code, m.Division_Code, d.name AS Division_Name, d.head AS Division_Head, "
    "d.region AS Division_Region FROM municipal_data m LEFT JOIN "
    f"(SELECT * FROM (VALUES {_DIV_VALUES}) v(Division_Code, name, head, region)) d "
    "ON m.Division_Code = d.Division_Code", "municipal_data")
ORACLES["dashboard"] = with_views(
    "SELECT m.MC_Code, m.MC_Name, m.Population, m.Total_Demand_MLD, m.Current_Supply_MLD, m.Division_Code, "
    f"{RN('eff_pred')} AS predicted_efficiency, CAST(risk_pred AS INT) AS critical_risk, "
    f"CASE WHEN eff_pred < 70.0 THEN {q(K.ACTION_INCREASE)} WHEN risk_pred = 1 THEN {q(K.ACTION_ROTATE)} "
    f"ELSE {q(K.ACTION_MAINTAIN)} END AS recommended_action, TIMESTAMP '2024-12-31 00:00:00' AS last_updated, "
    "h.Hub_ID, h.Hub_Name, coalesce(h.Total_Hubs, 0) AS Total_Hubs FROM mp2 m LEFT JOIN hubs h "
    "ON m.MC_Code = h.MC_Code", "municipal_data", "mc_hub_mapping", "hub_table", ctes=f"{MUNI_PRED}, {HUBS_CTE}")

# -------------------------------------------------------------- aggregations --
PUBLIC_SQL = (
    "(SELECT count(*) FROM municipal_data) AS Total_Municipal_Corporations, "
    "(SELECT CAST(sum(Population) AS BIGINT) FROM municipal_data) AS Total_Population, "
    f"(SELECT {dzr('avg(WQI)')} FROM quality_records) AS Average_WQI, "
    f"(SELECT {dzr('avg(Predicted_Supply_Efficiency)')} FROM distribution_records) "
    "AS Average_Distribution_Efficiency")
ORACLES["public_overall_stats"] = with_views(f"SELECT {PUBLIC_SQL}", "municipal_data", "quality_records",
                                             "distribution_records")
ORACLES["overall_stats"] = with_views(
    f"SELECT {PUBLIC_SQL}, "
    f"(SELECT CAST(coalesce(sum({ANOM}), 0) AS BIGINT) FROM quality_records) AS Total_Anomalies, "
    "(SELECT count(DISTINCT Hub_ID) FROM distribution_records WHERE Critical_Risk = 1) AS Total_Critical_Hubs, "
    "(SELECT max(c) FROM (SELECT max(Created_At) AS c FROM quality_records UNION "
    "SELECT max(Created_At) AS c FROM distribution_records) u) AS Last_Updated",
    "municipal_data", "quality_records", "distribution_records")
ORACLES["distribution_summary"] = with_views(
    f"SELECT MC_Code, {dzr('avg(Predicted_Supply_Efficiency)')} AS Average_Supply_Efficiency, "
    "count(DISTINCT CASE WHEN Critical_Risk = 1 THEN Hub_ID END) AS Total_Critical_Hubs, count(*) AS Total_Records, "
    f"{dzr('sum(Deficit_MLD)')} AS Total_Deficit_MLD FROM distribution_records GROUP BY MC_Code",
    "distribution_records")
QT_CTE = """qt AS (SELECT coalesce(MC_Code, '0') AS MC_Code, coalesce(Hub_ID, '0') AS Hub_ID,
    CASE WHEN isnan(WQI) OR isinf(WQI) THEN 0.0 ELSE WQI END AS WQI, coalesce(Anomaly_Status, '0') AS Anomaly_Status,
    Created_At FROM quality_records WHERE Created_At IS NOT NULL AND WQI IS NOT NULL AND NOT isnan(WQI))"""
ORACLES["quality_trend"] = with_views(
    f"SELECT MC_Code, Hub_ID, count(*) AS Total_Records, {RN('avg(WQI)')} AS Average_WQI, "
    f"CAST(sum({ANOM}) AS BIGINT) AS Anomaly_Count FROM qt GROUP BY MC_Code, Hub_ID", "quality_records", ctes=QT_CTE)
ORACLES["quality_trend_records"] = with_views(
    f"SELECT MC_Code, Hub_ID, CASE WHEN isnan(WQI) OR isinf(WQI) THEN NULL ELSE {RN('WQI', 3)} END AS WQI, "
    "Anomaly_Status, Created_At FROM qt", "quality_records", ctes=QT_CTE)
ORACLES["distribution_trend"] = with_views(
    f"SELECT MC_Code, Hub_ID, count(*) AS Total_Records, {RN('avg(Predicted_Supply_Efficiency)')} AS Average_Efficiency, "
    "CAST(sum(Critical_Risk) AS BIGINT) AS Critical_Count FROM distribution_records WHERE Hub_ID IS NOT NULL "
    "GROUP BY MC_Code, Hub_ID", "distribution_records")
ORACLES["yearly_quality_agg"] = with_views(
    "SELECT MC_Code, Hub_ID, Year, a AS Average_WQI, mx AS Max_WQI, mn AS Min_WQI, n AS Total_Records, "
    "an AS Anomaly_Count FROM agg", "quality_records", ctes=YQ_AGG)
ORACLES["yearly_distribution_agg"] = with_views("SELECT * FROM yagg", "distribution_records", ctes=YD_AGG)
ORACLES["state_trends"] = with_views(
    f"SELECT CAST(year(Created_At) AS INT) AS Year, {RN('avg(WQI)')} AS Avg_WQI, "
    f"{RN('avg(Predicted_Supply_Efficiency)')} AS Avg_Efficiency FROM ("
    "SELECT WQI, NULL AS Predicted_Supply_Efficiency, Created_At FROM quality_records UNION ALL "
    "SELECT NULL AS WQI, Predicted_Supply_Efficiency, Created_At FROM distribution_records) m "
    "WHERE Created_At IS NOT NULL GROUP BY CAST(year(Created_At) AS INT) ORDER BY Year",
    "quality_records", "distribution_records")
ORACLES["result_counts"] = with_views(
    "SELECT m.MC_Code, coalesce(q.n, 0) AS Total_Records, coalesce(q.an, 0) AS Total_Anomalies, "
    "coalesce(d.c, 0) AS Total_Critical_Instances, (SELECT count(*) FROM municipal_data) AS Total_Municipals "
    f"FROM municipal_data m LEFT JOIN (SELECT MC_Code, count(*) AS n, CAST(sum({ANOM}) AS BIGINT) AS an "
    "FROM quality_records GROUP BY MC_Code) q ON m.MC_Code = q.MC_Code LEFT JOIN (SELECT MC_Code, "
    "CAST(sum(CASE WHEN Critical_Risk = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c FROM distribution_records "
    "GROUP BY MC_Code) d ON m.MC_Code = d.MC_Code", "municipal_data", "quality_records", "distribution_records")

# ------------------------------------------------------------------- windows --
YD_WIN = YD_AGG + f""",
  ywin AS (SELECT *,
    avg(Average_Efficiency) OVER (PARTITION BY MC_Code, Hub_ID ORDER BY Year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
      AS Rolling_3yr_Avg,
    {RN('Average_Efficiency - lag(Average_Efficiency) OVER (PARTITION BY MC_Code, Hub_ID ORDER BY Year)')}
      AS Yearly_Delta,
    coalesce({RN('stddev_samp(Average_Efficiency) OVER (PARTITION BY MC_Code, Hub_ID ORDER BY Year '
                 'ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')}, 0.0) AS Volatility_Index,
    row_number() OVER (PARTITION BY MC_Code, Hub_ID ORDER BY Year) AS rn_asc,
    row_number() OVER (PARTITION BY MC_Code, Hub_ID ORDER BY Year DESC) AS rn_desc
  FROM yagg),
  ywin2 AS (SELECT *, {trend_sql('Yearly_Delta', K.YEARLY_TREND_STEP, K.STABLE)} AS Trend,
    {grade_sql('Average_Efficiency')} AS Performance_Grade FROM ywin),
  hubl AS (SELECT MC_Code, Hub_ID, count(*) AS ny,
    avg(CASE WHEN rn_asc <= 3 THEN Rolling_3yr_Avg END) AS early,
    avg(CASE WHEN rn_desc <= 3 THEN Rolling_3yr_Avg END) AS late,
    max(CASE WHEN rn_desc = 1 THEN CASE WHEN isnan(Average_Efficiency) OR isinf(Average_Efficiency) THEN NULL
        ELSE {RN('Average_Efficiency', 4)} END END) AS Latest_Efficiency,
    max(CASE WHEN rn_desc = 1 THEN CASE WHEN isnan(Volatility_Index) OR isinf(Volatility_Index) THEN NULL
        ELSE {RN('Volatility_Index', 4)} END END) AS Latest_Volatility
  FROM ywin GROUP BY MC_Code, Hub_ID),
  hubl2 AS (SELECT *, CASE WHEN ny < 3 THEN {q(K.INSUFFICIENT)} WHEN late - early > 2.0 THEN {q(K.IMPROVING)}
    WHEN late - early < -2.0 THEN {q(K.DEGRADING)} ELSE {q(K.STABLE)} END AS Long_Term_Trend FROM hubl)"""

ORACLES["rolling_3yr_avg"] = with_views(
    "SELECT MC_Code, Hub_ID, Year, Average_Efficiency, Rolling_3yr_Avg FROM ywin2", "distribution_records",
    ctes=YD_WIN)
ORACLES["yearly_efficiency_delta"] = with_views(
    "SELECT MC_Code, Hub_ID, Year, Average_Efficiency, Yearly_Delta, Trend FROM ywin2", "distribution_records",
    ctes=YD_WIN)
ORACLES["volatility_index"] = with_views(
    "SELECT MC_Code, Hub_ID, Year, Average_Efficiency, Volatility_Index FROM ywin2", "distribution_records",
    ctes=YD_WIN)
ORACLES["long_term_trend"] = with_views("SELECT MC_Code, Hub_ID, Long_Term_Trend FROM hubl2",
                                        "distribution_records", ctes=YD_WIN)
ORACLES["lower_na_text"] = with_views(
    "SELECT MC_Code, Hub_ID, coalesce(lower(Long_Term_Trend), 'N/A') AS Trend_Text FROM hubl2",
    "distribution_records", ctes=YD_WIN)
ORACLES["latest_year_per_hub"] = with_views(
    "SELECT h.MC_Code, h.Hub_ID, y.Year AS Latest_Year, h.Latest_Efficiency, h.Latest_Volatility FROM hubl2 h "
    "JOIN ywin2 y ON h.MC_Code = y.MC_Code AND h.Hub_ID = y.Hub_ID AND y.rn_desc = 1", "distribution_records",
    ctes=YD_WIN)


def _nn4(x: str) -> str:
    return f"CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {RN(x, 4)} END"


ORACLES["yearly_distribution_trend"] = with_views(
    f"SELECT y.MC_Code, y.Hub_ID, y.Year, {_nn4('y.Average_Efficiency')} AS Average_Efficiency, y.Critical_Count, "
    f"{_nn4('y.Rolling_3yr_Avg')} AS Rolling_3yr_Avg, {_nn4('y.Yearly_Delta')} AS Yearly_Delta, y.Trend, "
    f"y.Performance_Grade, {_nn4('y.Volatility_Index')} AS Volatility_Index, h.Long_Term_Trend, "
    "'Hub ' || y.Hub_ID || ' shows a ' || coalesce(lower(h.Long_Term_Trend), 'N/A') || "
    "' trend overall. Latest efficiency is ' || coalesce(CAST(h.Latest_Efficiency AS VARCHAR), 'N/A') || "
    "'%. Volatility Index: ' || coalesce(CAST(h.Latest_Volatility AS VARCHAR), 'N/A') || '.' AS AI_Commentary "
    "FROM ywin2 y JOIN hubl2 h ON y.MC_Code = h.MC_Code AND y.Hub_ID = h.Hub_ID",
    "distribution_records", ctes=YD_WIN)
ORACLES["latest_distribution"] = with_views(LATEST_SQL, "distribution_records")

# ------------------------------------------------------ sorts, limits, sets --
REC_COLS = ["l_orderkey", "l_linenumber", "MC_Code", "Hub_ID", "Temperature", "pH", "BOD", "Faecal_Coliform",
            "Total_Coliform", "Nitrate", "Conductivity", "WQI", "Anomaly_Status", "Created_At", "Used_For_Training",
            "Category"]
ORACLES["quality_records"] = with_views("SELECT * FROM quality_records", "quality_records")
_TIE = ", ".join(f"{c} ASC NULLS FIRST" for c in REC_COLS if c not in ("MC_Code", "Created_At"))
ORACLES["quality_history_top10"] = with_views(
    f"SELECT {', '.join(REC_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY MC_Code "
    f"ORDER BY Created_At DESC NULLS LAST, {_TIE}) AS rk FROM quality_records) z WHERE rk <= 10",
    "quality_records")
ORACLES["anomaly_summary"] = with_views(
    "SELECT a.*, c.n AS Total_Anomalies, '⚠️ ' || CAST(c.n AS VARCHAR) || ' anomalies detected' AS Message "
    f"FROM (SELECT MC_Code, Hub_ID, WQI, Anomaly_Status, Created_At FROM quality_records "
    f"WHERE Anomaly_Status = {q(K.ANOMALY)}) a JOIN (SELECT MC_Code, count(*) AS n FROM quality_records "
    f"WHERE Anomaly_Status = {q(K.ANOMALY)} GROUP BY MC_Code) c ON a.MC_Code = c.MC_Code", "quality_records")
ORACLES["anomaly_counts"] = with_views(
    "SELECT m.MC_Code, coalesce(c.n, 0) AS Total_Anomalies, CASE WHEN coalesce(c.n, 0) = 0 THEN "
    f"{q(K.NO_ANOMALIES)} ELSE '⚠️ ' || CAST(c.n AS VARCHAR) || ' anomalies detected' END AS Message "
    f"FROM municipal_data m LEFT JOIN (SELECT MC_Code, count(*) AS n FROM quality_records "
    f"WHERE Anomaly_Status = {q(K.ANOMALY)} GROUP BY MC_Code) c ON m.MC_Code = c.MC_Code",
    "municipal_data", "quality_records")
ORACLES["critical_summary"] = with_views(
    "SELECT a.*, c.n AS Total_Critical_Instances, "
    "'⚠️ ' || CAST(c.n AS VARCHAR) || ' critical risk events recorded' AS Message "
    "FROM (SELECT MC_Code, Hub_ID, Predicted_Supply_Efficiency, Critical_Risk, Recommended_Action, Created_At "
    "FROM distribution_records WHERE Critical_Risk = 1) a JOIN (SELECT MC_Code, count(*) AS n "
    "FROM distribution_records WHERE Critical_Risk = 1 GROUP BY MC_Code) c ON a.MC_Code = c.MC_Code",
    "distribution_records")
ORACLES["municipal_list"] = with_views(
    "SELECT MC_Code, MC_Name, (SELECT count(*) FROM municipal_data) AS Total_Municipals FROM municipal_data",
    "municipal_data")
ORACLES["ordered_history"] = with_views(
    "SELECT MC_Code, Hub_ID, WQI, Anomaly_Status, Created_At FROM quality_records", "quality_records")
ORACLES["last_updated"] = with_views(
    "SELECT max(c) AS Last_Updated FROM (SELECT max(Created_At) AS c FROM quality_records UNION "
    "SELECT max(Created_At) AS c FROM distribution_records) u", "quality_records", "distribution_records")
ORACLES["merged_measurements"] = with_views(
    "SELECT WQI, NULL::DOUBLE AS Predicted_Supply_Efficiency, Created_At FROM quality_records UNION ALL "
    "SELECT NULL::DOUBLE AS WQI, Predicted_Supply_Efficiency, Created_At FROM distribution_records",
    "quality_records", "distribution_records")

# ------------------------------------------------------------------- nested --
W1_CTE = f"""{YQ_AGG},
  keys AS (SELECT DISTINCT MC_Code, Hub_ID FROM agg),
  spine AS (SELECT MC_Code, Hub_ID, CAST(y AS INT) AS Year FROM keys, range({K.FIRST_REPORT_YEAR}, 2025) t(y)),
  grid AS (SELECT s.MC_Code, s.Hub_ID, s.Year, g.a, g.n FROM spine s LEFT JOIN agg g
    ON s.MC_Code = g.MC_Code AND s.Hub_ID = g.Hub_ID AND s.Year = g.Year),
  w1 AS (SELECT MC_Code, Hub_ID, Year, CASE WHEN n IS NOT NULL THEN a ELSE 0.0 END AS Average_WQI FROM grid)"""
ORACLES["year_map_rows"] = with_views(
    "SELECT MC_Code, Hub_ID, CAST(Year AS VARCHAR) AS year, Average_WQI FROM w1", "quality_records", ctes=W1_CTE)
ORACLES["hub_lookup"] = with_views(
    "SELECT m.MC_Code, m.Hub_ID, CAST(count(w.Year) OVER (PARTITION BY m.MC_Code, m.Hub_ID) AS INT) AS Years_Found, "
    "CAST(w.Year AS VARCHAR) AS Year, w.Average_WQI, w.Total_Records "
    "FROM (SELECT MC_Code, Hub_ID FROM mc_hub_mapping UNION ALL SELECT MC_Code, 'HUB0000' FROM municipal_data) m "
    "LEFT JOIN w1 w ON m.MC_Code = w.MC_Code AND m.Hub_ID = w.Hub_ID",
    "quality_records", "mc_hub_mapping", "municipal_data",
    ctes=f"w1 AS ({ORACLES['yearly_quality_trend']})")
ORACLES["year_map"] = (
    "SELECT MC_Code, Hub_ID, CAST(Year AS VARCHAR) AS Year, Average_WQI, Max_WQI, Min_WQI, Total_Records, Anomaly_Count, "
    f"Trend, Yearly_Delta FROM ({ORACLES['yearly_quality_trend']}) y")
ORACLES["trend_by_hub_map"] = ORACLES["quality_trend"]
ORACLES["report_json"] = ORACLES["yearly_distribution_trend"]
ORACLES["quality_details"] = with_views(
    f"SELECT l_orderkey, l_linenumber, {RN(ML_WQI)} AS ML_WQI, Rule_WQI, {q(K.HYBRID_MODEL_TEXT)} AS Hybrid_Model, "
    "Temperature, pH, BOD, Faecal_Coliform, Total_Coliform, Nitrate_N, Conductivity FROM quality_scored", "quality_scored")

# --------------------------------------------------------- sources and sinks --
ORACLES["scan_municipal_csv"] = with_views(
    "SELECT MC_Code, MC_Name, Population, Total_Demand_MLD, Current_Supply_MLD FROM municipal_data", "municipal_data")
ORACLES["scan_table_params"] = with_views(
    "SELECT Hub_ID, WQI, Anomaly_Status, Created_At FROM quality_records WHERE MC_Code = 'MC007'", "quality_records")

P1_CTE = f"""p1a AS (SELECT *, {ML_WQI} AS ml_wqi, {ANOM_PRED} AS anomaly_pred FROM quality_scored),
  p1b AS (SELECT *, {PYR('ml_wqi*0.7::DOUBLE + Rule_WQI*0.3::DOUBLE')} AS WQI FROM p1a),
  p1c AS (SELECT *, {quality_band_sql('WQI', 1)} AS Category, {quality_band_sql('WQI', 2)} AS Emoji_Status,
    {quality_band_sql('WQI', 3)} AS Interpretation, {quality_band_sql('WQI', 4)} AS Recommended_Action,
    {HIT} AS hit FROM p1b),
  p1d AS (SELECT * REPLACE (
      CASE WHEN hit THEN least(WQI, {K.SAFETY_WQI_CEILING!r}) ELSE WQI END AS WQI,
      CASE WHEN hit THEN {q(K.SAFETY_CATEGORY)} ELSE Category END AS Category,
      CASE WHEN hit THEN {q(K.SAFETY_EMOJI)} ELSE Emoji_Status END AS Emoji_Status,
      CASE WHEN hit THEN {q(K.SAFETY_INTERPRETATION)} ELSE Interpretation END AS Interpretation,
      CASE WHEN hit THEN {q(K.SAFETY_ACTION)} ELSE Recommended_Action END AS Recommended_Action),
    CASE WHEN hit AND WQI > {K.SAFETY_WQI_CEILING!r} THEN '35' ELSE CAST(WQI AS VARCHAR) END AS WQI_Text FROM p1c),
  p1 AS (SELECT * REPLACE (
      CASE WHEN anomaly_pred = -1 THEN {q(K.ANOMALY_EMOJI)} ELSE Emoji_Status END AS Emoji_Status,
      CASE WHEN anomaly_pred = -1 THEN Recommended_Action || {q(K.ANOMALY_ACTION_SUFFIX)}
           ELSE Recommended_Action END AS Recommended_Action),
    CASE WHEN anomaly_pred = -1 THEN {q(K.ANOMALY)} ELSE {q(K.NORMAL)} END AS Anomaly_Status FROM p1d)"""

ORACLES["predict_quality"] = with_views(
    "SELECT l_orderkey, l_linenumber, Created_At, MC_Code, Hub_ID, WQI AS Final_WQI, Category, Emoji_Status, "
    f"Anomaly_Status, Interpretation, Recommended_Action, {RN('ml_wqi')} AS ML_WQI, Rule_WQI, "
    f"{q(K.HYBRID_MODEL_TEXT)} AS Hybrid_Model, Temperature, pH, BOD, Faecal_Coliform, Total_Coliform, Nitrate_N, "
    "Conductivity, Emoji_Status || ' The AI predicts a WQI of ' || WQI_Text || ' (' || Category || '). ' || "
    "Interpretation || ' Recommended action: ' || Recommended_Action AS AI_Summary, "
    "'✅ Record saved successfully for Hub ' || Hub_ID || '.' AS Message FROM p1", "quality_scored", ctes=P1_CTE)
QREC_SQL = ("SELECT MC_Code, Hub_ID, Temperature, pH, BOD, Faecal_Coliform, Total_Coliform, Nitrate_N AS Nitrate, "
            "Conductivity, WQI, Category, Anomaly_Status, date_trunc('second', Created_At) AS Created_At, "
            "0 AS Used_For_Training FROM p1")
ORACLES["append_quality"] = with_views(QREC_SQL, "quality_scored", ctes=P1_CTE)
ORACLES["stream_quality"] = ORACLES["append_quality"]
DREC_SQL = ("SELECT MC_Code, Hub_ID, Total_Demand_MLD, Current_Supply_MLD, Population, Deficit_MLD, PerCapita_LPCD, "
            "Predicted_Supply_Efficiency, Critical_Risk, Recommended_Action, date_trunc('second', Created_At) "
            "AS Created_At FROM distribution_records")
ORACLES["append_distribution"] = with_views(DREC_SQL, "distribution_records")
ORACLES["stream_distribution"] = ORACLES["append_distribution"]
ORACLES["predict_distribution"] = with_views(
    "SELECT o_orderkey, Created_At, Total_Demand_MLD, Current_Supply_MLD, Population, Predicted_Supply_Efficiency, "
    "Advice, MC_Code, Hub_ID, Predicted_Supply_Efficiency AS Final_Efficiency, Performance_Grade, "
    "Risk_Label AS Status, Emoji_Status, Critical_Risk_B AS Critical_Risk, Deficit_MLD, PerCapita_LPCD, "
    "Interpretation, Emoji_Status || ' Hub ' || Hub_ID || ' operates at ' || "
    "CAST(Predicted_Supply_Efficiency AS VARCHAR) || '% efficiency (' || Performance_Grade || '). ' || "
    "Interpretation || ' Recommended next action: ' || Advice AS AI_Commentary, Advice AS Recommended_Action, "
    "Emoji_Status || ' ' || Performance || ' performance with ' || CAST(Predicted_Supply_Efficiency AS VARCHAR) || "
    "'% efficiency. ' || Interpretation AS Summary, "
    "'✅ AI-enhanced distribution prediction saved for Hub ' || Hub_ID AS Message FROM distribution_scored",
    "distribution_scored")
ORACLES["mark_used_for_training"] = with_views(
    "SELECT MC_Code, Hub_ID, WQI, Created_At, CASE WHEN Used_For_Training = 0 THEN 1 ELSE Used_For_Training END "
    "AS Used_For_Training FROM quality_records", "quality_records")
ORACLES["scan_training"] = with_views(
    "SELECT Temperature, pH, BOD, Faecal_Coliform, Total_Coliform, Nitrate_N AS Nitrate, Conductivity, "
    f"Rule_WQI AS WQI, CASE WHEN {ANOM_PRED} = -1 THEN {q(K.ANOMALY)} ELSE {q(K.NORMAL)} END AS Anomaly_Status "
    "FROM quality_scored", "quality_scored")

# ----------------------------------------------------------------------- ML --
_F = list(K.ML_FEATURES)
_NN = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in _F + ["WQI"])
TRAIN_CTE = (f"ts AS (SELECT {', '.join(_F)}, WQI, Anomaly_Status FROM quality_records "
             f"WHERE Temperature IS NOT NULL AND Anomaly_Status IS NOT NULL AND {_NN})")
ORACLES["training_set"] = with_views("SELECT * FROM ts", "quality_records", ctes=TRAIN_CTE)
ORACLES["scaler_stats"] = with_views(
    "SELECT " + ", ".join(f"avg({f}) AS mean_{f}, stddev_pop({f}) AS std_{f}" for f in _F) + " FROM ts",
    "quality_records", ctes=TRAIN_CTE)
_STATS = "st AS (SELECT " + ", ".join(
    f"avg({f}) AS m_{f}, CASE WHEN coalesce(stddev_pop({f}), 0) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}"
    for f in _F) + " FROM ts)"
ORACLES["scaled_features"] = with_views(
    # six digits: means are summed in another order on each side
    "SELECT " + ", ".join(f"round((ts.{f} - st.m_{f}) / st.s_{f}, 6) AS z_{f}" for f in _F) + ", ts.WQI FROM ts, st",
    "quality_records", ctes=TRAIN_CTE + ",\n" + _STATS)
# M3/M4: the isolation forest in SQL.  Sample: a record's MD5 says how many of the 200 trees it goes to and which.
# Growth: level by level, a node's feature and threshold from the MD5 of (seed, tree, node).
_Z = [f"z{i}" for i in range(len(_F))]
_TREES, _LEVELS, _PSI = K.N_TREES, 8, K.ISOLATION_SAMPLE


def _lane(h: str, i: int) -> str:
    return f"(CAST('0x' || substr({h}, {8 * i + 1}, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _path_sql(n: str) -> str:
    return (f"CASE WHEN {n} <= 1 THEN 0e0 WHEN {n} = 2 THEN 1e0 ELSE 2e0 * (ln({n} - 1e0) + 0.5772156649015329e0) "
            f"- 2e0 * ({n} - 1e0) / {n} END")


def _forest_ctes() -> str:
    keyed = (f"tk AS MATERIALIZED (SELECT l_orderkey, l_linenumber, Hub_ID, Created_At, {', '.join(_F)}, WQI FROM quality_records "
             f"WHERE Temperature IS NOT NULL AND Anomaly_Status IS NOT NULL AND {_NN})")
    out = [keyed, _STATS.replace("FROM ts", "FROM tk"),
           "zt AS MATERIALIZED (SELECT l_orderkey, l_linenumber, Hub_ID, Created_At, WQI, "
           + ", ".join(f"(tk.{f} - st.m_{f}) / st.s_{f} AS z{i}" for i, f in enumerate(_F))
           + f", md5('{K.SEED}|' || md5(concat_ws('|', l_orderkey, l_linenumber, Hub_ID, Created_At))) AS h FROM tk, st)",
           f"want AS (SELECT least(1e0, 1.25e0 * {_PSI} / count(*)) * {_TREES}e0 AS w FROM tk)",
           f"m AS (SELECT zt.*, CAST(floor(w) AS BIGINT) + CASE WHEN {_lane('h', 0)} < w - floor(w) THEN 1 ELSE 0 END AS m FROM zt, want)",
           f"""picks AS (SELECT {', '.join(_Z)}, h, CAST((floor((j + {_lane('h', 1)}) * {_TREES}e0 / m)
             + floor({_lane('h', 2)} * {_TREES}e0)) AS BIGINT) % {_TREES} AS t FROM m, range({2 * _TREES}) r(j) WHERE j < m)""",
           f"""s0 AS MATERIALIZED (SELECT {', '.join(_Z)}, t, CAST(1 AS BIGINT) AS node FROM picks
             QUALIFY row_number() OVER (PARTITION BY t ORDER BY md5(h || '|' || CAST(t AS VARCHAR))) <= {_PSI})"""]
    for d in range(_LEVELS + 1):
        bounds = ", ".join(f"min({z}) AS lo_{z}, max({z}) AS hi_{z}" for z in _Z)
        out.append(f"g{d} AS MATERIALIZED (SELECT t, node, count(*) AS n, {bounds} FROM s{d} GROUP BY t, node)")
        if d == _LEVELS:
            out.append(f"n{d} AS (SELECT t, node, -1 AS f, 0e0 AS thr, n, {d} AS depth FROM g{d})")
            break
        lists = ", ".join(f"CASE WHEN hi_{z} > lo_{z} THEN {i} END" for i, z in enumerate(_Z))
        lo, hi = (f"[{', '.join(f'{e}_{z}' for z in _Z)}]" for e in ("lo", "hi"))
        out += [f"""c{d} AS (SELECT *, [x FOR x IN [{lists}] IF x IS NOT NULL] AS cand, {lo} AS lo, {hi} AS hi,
             md5('{K.SEED}|' || t || '|' || node) AS nh FROM g{d})""",
                f"""f{d} AS (SELECT *, CASE WHEN len(cand) = 0 THEN -1 ELSE
             cand[CAST(floor({_lane('nh', 0)} * len(cand)) AS BIGINT) + 1] END AS f FROM c{d})""",
                f"""n{d} AS MATERIALIZED (SELECT t, node, f, CASE WHEN f < 0 THEN 0e0 ELSE
             lo[f + 1] + {_lane('nh', 1)} * (hi[f + 1] - lo[f + 1]) END AS thr, n, {d} AS depth FROM f{d})""",
                f"""s{d + 1} AS MATERIALIZED (SELECT {', '.join('s.' + z for z in _Z)}, s.t, 2 * s.node +
             CASE WHEN {_feature('s')} < k.thr THEN 0 ELSE 1 END AS node FROM s{d} s JOIN n{d} k ON s.t = k.t AND s.node = k.node
             WHERE k.f >= 0)"""]
    out.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(_LEVELS + 1)) + ")")
    return ",\n".join(out)


def _feature(row: str) -> str:
    return "CASE k.f " + " ".join(f"WHEN {i} THEN {row}.{z}" for i, z in enumerate(_Z)) + " END"


def _walk_ctes() -> str:
    rid = "l_orderkey, l_linenumber, Hub_ID, Created_At, WQI, " + ", ".join(_Z)
    out = [f"w0 AS (SELECT {rid}, t, CAST(1 AS BIGINT) AS node FROM zt, range({_TREES}) r(t))"]
    for d in range(_LEVELS):
        out.append(f"""w{d + 1} AS (SELECT {', '.join('s.' + c for c in rid.split(', '))}, s.t,
          CASE WHEN k.f IS NULL OR k.f < 0 THEN s.node WHEN {_feature('s')} < k.thr THEN 2 * s.node ELSE 2 * s.node + 1 END AS node
          FROM w{d} s LEFT JOIN n{d} k ON s.t = k.t AND s.node = k.node)""")
    out.append(f"""scored AS MATERIALIZED (SELECT l_orderkey, l_linenumber, Hub_ID, Created_At, any_value(s.WQI) AS WQI,
      round_even(pow(2e0, -(sum(k.depth + {_path_sql('k.n')}) / {_TREES}e0) / ({_path_sql(str(_PSI) + 'e0')})) * 1e6, 0) / 1e6 AS sc
      FROM w{_LEVELS} s JOIN nodes k ON s.t = k.t AND s.node = k.node AND (k.f < 0 OR k.depth = {_LEVELS})
      GROUP BY l_orderkey, l_linenumber, Hub_ID, Created_At)""")
    out.append(f"cut AS (SELECT quantile_cont(sc, {1 - K.CONTAMINATION!r}) AS c FROM scored)")
    return ",\n".join(out)


ORACLES["train_isolation_forest"] = with_views(
    "SELECT CAST(t AS INT) AS tree_id, CAST(node AS INT) AS node_id, CAST(f AS INT) AS feature, round(thr, 6) AS threshold, "
    "CAST(CASE WHEN f < 0 THEN -1 ELSE 2 * node END AS INT) AS left_child, "
    "CAST(CASE WHEN f < 0 THEN -1 ELSE 2 * node + 1 END AS INT) AS right_child, n AS size, CAST(depth AS INT) AS depth "
    "FROM nodes", "quality_records", ctes=_forest_ctes())
ORACLES["score_anomalies"] = with_views(
    "SELECT l_orderkey, l_linenumber, Hub_ID, Created_At, WQI, sc AS anomaly_score, CASE WHEN sc > c THEN -1 ELSE 1 END AS anomaly_pred "
    "FROM scored, cut", "quality_records", ctes=_forest_ctes() + ",\n" + _walk_ctes())

# M2/M5, M7 without a bootstrap: trees grown to purity give each row the mean label of the rows with equal features
ORACLES["score_wqi_full_trees"] = with_views(
    f"SELECT l_orderkey, l_linenumber, Hub_ID, Created_At, WQI, round(avg(WQI) OVER (PARTITION BY {', '.join(_F)}), 6) AS ml_wqi FROM quality_records "
    f"WHERE Temperature IS NOT NULL AND Anomaly_Status IS NOT NULL AND {_NN}", "quality_records")
ORACLES["score_criticality_full_trees"] = with_views(
    "SELECT o_orderkey, Hub_ID, CASE WHEN Current_Supply_MLD / Total_Demand_MLD * 100.0 < 70.0 THEN 1 ELSE 0 END AS risk_pred "
    "FROM distribution_inputs", "distribution_inputs")
ORACLES["model_roundtrip"] = with_views(
    "SELECT count(*) AS Rows_Scored, TRUE AS Reloaded_Equal, TRUE AS Flagged_Near_Two_Percent, 200 AS Regression_Trees, "
    "200 AS Isolation_Trees FROM ts", "quality_records", ctes=TRAIN_CTE)
ORACLES["anomaly_target"] = with_views(
    f"SELECT Hub_ID, Anomaly_Status, CASE WHEN Anomaly_Status = {q(K.ANOMALY)} THEN -1 ELSE 1 END AS anomaly_target "
    "FROM quality_records", "quality_records")
ORACLES["regression_eval"] = with_views(
    "SELECT 1.0 - sum((y - p) * (y - p)) / sum((y - (SELECT avg(Rule_WQI) FROM quality_scored)) * "
    "(y - (SELECT avg(Rule_WQI) FROM quality_scored))) AS R2, avg(abs(y - p)) AS MAE, count(*) AS N "
    f"FROM (SELECT Rule_WQI AS y, {ML_WQI} AS p FROM quality_scored) z", "quality_scored")
ORACLES["distribution_trend_records"] = with_views(
    "SELECT MC_Code, Hub_ID, Predicted_Supply_Efficiency, Critical_Risk, Created_At FROM distribution_records "
    "WHERE Hub_ID IS NOT NULL", "distribution_records")
