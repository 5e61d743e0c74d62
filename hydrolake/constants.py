"""Fixed values of the water-quality and distribution rules.

Everything in this module is a FIXED VALUE that must equal the rule set being
reproduced (weights, standards, caps, band edges and the exact texts shown to
operators).  They are kept here, in natural order, so that the Spark
expressions and the SQL oracles are built from one place.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: rule-based WQI
# ---------------------------------------------------------------------------

# The seven measured parameters, in the order the rule sums them.
PARAMS = (
    "Temperature",
    "pH",
    "Conductivity",
    "BOD",
    "Faecal_Coliform",
    "Total_Coliform",
    "Nitrate_N",
)

# Reading columns come as <param>_Min / <param>_Max pairs.
READING_PARAMS = PARAMS

# Weight of each sub-score in the rule WQI.
WEIGHTS = {
    "Temperature": 0.1,
    "pH": 0.2,
    "Conductivity": 0.1,
    "BOD": 0.2,
    "Faecal_Coliform": 0.2,
    "Total_Coliform": 0.1,
    "Nitrate_N": 0.1,
}

# Reference standards actually read by the sub-scores (temperature and pH).
STANDARD_TEMPERATURE = 25.0
STANDARD_PH = 7.0

# Upper caps applied before scoring (no lower bound).
CAPS = {
    "pH": 14.0,
    "BOD": 50.0,
    "Faecal_Coliform": 2000.0,
    "Total_Coliform": 2000.0,
    "Nitrate_N": 50.0,
    "Conductivity": 100000.0,
    "Temperature": 50.0,
}

# Blend of model and rule WQI.
ML_SHARE = 0.7
RULE_SHARE = 0.3

# Five-band category on the rounded WQI: (lower edge, category, emoji,
# interpretation, action); the last band has no lower edge.
QUALITY_BANDS = (
    (80.0, "Excellent", "💧",
     "Water quality is excellent — clean, safe, and fit for all domestic and industrial uses.",
     "Continue regular monitoring. Maintain current supply and sanitation standards."),
    (65.0, "Good", "✅",
     "Water quality is good — generally safe for domestic use. Occasional treatment may be required.",
     "Recommend monthly bacterial checks and quarterly chemical sampling."),
    (50.0, "Moderate", "⚠️",
     "Water quality is moderate — safe for limited domestic use but not advisable for direct consumption.",
     "Increase monitoring frequency. Consider mild chlorination or filtration improvement."),
    (30.0, "Poor", "🚨",
     "Water quality is poor — indicates contamination risk, unsafe for direct use.",
     "Immediate water treatment required. Investigate contamination sources."),
    (None, "Very Poor", "☠️",
     "Water is severely polluted — unsafe for any use without purification.",
     "Urgent intervention: conduct microbial testing and suspend direct water supply."),
)

# Three-band category (defined by the rules, never called by the scoring path).
QUALITY_BANDS3 = ((70.0, "Good"), (50.0, "Moderate"), (None, "Poor"))

# Safety downgrade: thresholds, ceiling and texts.
SAFETY_PH_BELOW = 5.5
SAFETY_BOD_ABOVE = 20.0
SAFETY_FC_ABOVE = 5000.0
SAFETY_WQI_CEILING = 35.0
SAFETY_CATEGORY = "Very Poor"
SAFETY_EMOJI = "☠️"
SAFETY_INTERPRETATION = "Severe contamination detected — unsafe water."
SAFETY_ACTION = "Immediate isolation and thorough water treatment recommended."

# Anomaly label and what it does to the emoji and action.
ANOMALY = "Anomaly Detected"
NORMAL = "Normal"
ANOMALY_EMOJI = "⚠️"
ANOMALY_ACTION_SUFFIX = " Possible sensor or data anomaly — recheck readings."

HYBRID_MODEL_TEXT = "70% AI + 30% Rule-based"

# ---------------------------------------------------------------------------
# FIXED VALUES: distribution rules
# ---------------------------------------------------------------------------

PUMPING_CUT = 70.0
ACTION_INCREASE = "Increase pumping / reduce non-revenue water"
ACTION_ROTATE = "Implement rotational supply or leakage audit"
ACTION_MAINTAIN = "Maintain normal operation"
STATUS_CRITICAL = "⚠️ Critical"
STATUS_STABLE = "✅ Stable"

# Performance bands on the rounded efficiency: (lower edge, performance,
# emoji, interpretation template, advice, grade).  Templates use {eff},
# {deficit} and {lpcd} for the rounded efficiency, deficit and per-capita.
PERFORMANCE_BANDS = (
    (85.0, "Excellent", "💧",
     "Supply system is performing excellently with {eff}% efficiency. "
     "Water distribution is balanced and sustainable at current levels.",
     "Continue current operation. Perform preventive maintenance bi-monthly.",
     "A (Excellent)"),
    (70.0, "Good", "✅",
     "Efficiency is healthy at {eff}%. System is reliable but can be optimized further.",
     "Monitor consumption growth. Conduct a quarterly leakage audit.",
     "B (Good)"),
    (55.0, "Moderate", "⚠️",
     "Efficiency at {eff}% suggests strain on supply or losses due to leakage. "
     "Deficit of {deficit} MLD may lead to periodic shortages.",
     "Optimize pumping schedules, fix leaks, and assess non-revenue water zones.",
     "C (Moderate)"),
    (40.0, "Poor", "🚨",
     "Low efficiency ({eff}%) indicates critical imbalance between demand and supply. "
     "Shortfall of {deficit} MLD affecting per capita supply ({lpcd} LPCD).",
     "Prioritize network repair and pressure zoning. Consider tanker support or staggered supply.",
     "D (Poor)"),
    (None, "Critical", "☠️",
     "Severe inefficiency detected ({eff}%). Water crisis likely. "
     "Supply deficit of {deficit} MLD has created emergency conditions.",
     "Activate emergency protocols. Reduce non-revenue water, initiate alternate supply routes, "
     "and coordinate with municipal crisis teams immediately.",
     "E (Critical)"),
)

RISK_LABEL_CRITICAL = "⚠️ Critical Risk"
RISK_LABEL_STABLE = "✅ Stable"
RISK_ADVICE_CRITICAL = " AI indicates critical distribution risk — immediate field inspection advised."
RISK_ADVICE_STABLE = " Maintain current flow and monitoring routines."
GRADE_UNKNOWN = "Unknown"

# Trend labels and thresholds.
IMPROVING = "Improving"
DEGRADING = "Degrading"
STABLE = "Stable"
NOT_AVAILABLE = "N/A"
INSUFFICIENT = "Insufficient Data"
YEARLY_TREND_STEP = 1.0
LONG_TERM_STEP = 2.0

# Yearly quality report starts here (inclusive).
FIRST_REPORT_YEAR = 2018

# Count messages.
NO_ANOMALIES = "✅ No anomalies detected"
ANOMALIES_FMT = "⚠️ {n} anomalies detected"
NO_CRITICAL = "✅ No critical risk hubs detected"
CRITICAL_FMT = "⚠️ {n} critical risk events recorded"

# ---------------------------------------------------------------------------
# FIXED VALUES: sentences of the reports ({...}: the column put in)
# ---------------------------------------------------------------------------

QUALITY_SUMMARY = ("{Emoji_Status} The AI predicts a WQI of {wqi} ({Category}). {Interpretation} "
                   "Recommended action: {Recommended_Action}")
QUALITY_SAVED = "✅ Record saved successfully for Hub {Hub_ID}."
DISTRIBUTION_COMMENTARY = ("{Emoji_Status} Hub {Hub_ID} operates at {eff}% efficiency ({Performance_Grade}). {Interpretation} "
                           "Recommended next action: {Advice}")
DISTRIBUTION_SUMMARY = "{Emoji_Status} {Performance} performance with {eff}% efficiency. {Interpretation}"
DISTRIBUTION_SAVED = "✅ AI-enhanced distribution prediction saved for Hub {Hub_ID}"
TREND_COMMENTARY = ("Hub {Hub_ID} shows a {trend} trend overall. Latest efficiency is {efficiency}%. "
                    "Volatility Index: {volatility}.")

# ---------------------------------------------------------------------------
# FIXED VALUES: division dimension (code, name, head, region)
# ---------------------------------------------------------------------------

DIVISIONS = (
    ("D01", "Konkan Division", "Shri A. B. Patil (Divisional Commissioner)", "Mumbai, Thane, Raigad"),
    ("D02", "Pune Division", "Shri R. S. Gaikwad (Divisional Commissioner)", "Pune, Kolhapur, Satara, Sangli, Solapur"),
    ("D03", "Nashik Division", "Shri M. N. Deshmukh (Divisional Commissioner)",
     "Nashik, Dhule, Jalgaon, Nandurbar, Ahmednagar"),
    ("D04", "Aurangabad Division", "Shri P. S. Jadhav (Divisional Commissioner)",
     "Aurangabad, Latur, Nanded, Parbhani, Beed, Osmanabad"),
    ("D05", "Amravati Division", "Shri V. G. Shinde (Divisional Commissioner)",
     "Akola, Amravati, Buldhana, Washim, Yavatmal"),
    ("D06", "Nagpur Division", "Shri S. T. Kulkarni (Divisional Commissioner)",
     "Nagpur, Bhandara, Gondia, Chandrapur, Wardha, Gadchiroli"),
)

# Model defaults: 200 trees, seed 42, 2% contamination.
N_TREES = 200
SEED = 42
CONTAMINATION = 0.02
ISOLATION_SAMPLE = 256

# Feature order of the WQI models.
ML_FEATURES = ("Temperature", "pH", "BOD", "Faecal_Coliform", "Total_Coliform", "Nitrate", "Conductivity")
# Feature order of the distribution models.
DIST_FEATURES = ("Population", "Total_Demand_MLD", "Current_Supply_MLD", "Deficit_MLD", "PerCapita_LPCD")
