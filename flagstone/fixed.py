"""Fixed values.

Word lists, patterns, bands, caps and wordings whose exact content decides the results. They are
data, stated once, in plain text; every module reads them from here.
"""

from __future__ import annotations

# --- flags and states -----------------------------------------------------------------------
FLAGS = ["GREEN", "RED", "NEUTRAL", "NOT_AVAILABLE"]
COMMITTED = ["DONE", "NEEDS_REVIEW"]
RESULT_STATUSES = ["PENDING", "DONE", "NEEDS_REVIEW", "ERROR", "DEFERRED"]
RUN_STATUSES = ["QUEUED", "HARVESTING", "HARVESTED", "PROCESSING", "PARTIAL", "DONE", "ERROR"]
ELIGIBLE_RUNS = ["HARVESTED", "PARTIAL"]
RESUMABLE_RUNS = ["HARVESTED", "PARTIAL", "PROCESSING"]
IN_FLIGHT_RUNS = ["QUEUED", "HARVESTING", "HARVESTED", "PROCESSING"]
NOT_AVAILABLE_TEXT = "not available"
ERROR_ANSWER_PREFIX = "[Error]"
DUPLICATE_PREFIX = "duplicate of "
TABLE_MARKER = "\u0001TBL1\u0001"

# --- limits ---------------------------------------------------------------------------------
STALE_AFTER_DAYS = 90
IDLE_MINUTES = 12
RESUME_BATCH = 8
FALLBACK_ITEM_COUNT = 103
CACHE_TTL_DAYS = 90
AUDIT_MIN_ROWS = 20
DIM_GUARD = 50
VERDICT_CHARS = 700
CHUNK_CHARS = 3000
PASSAGES_KEPT = 4
PASSAGE_BUDGET = 6500
PASSAGE_RADIUS = 900
SECTION_WINDOW = 4500
NOTE_BUDGET = 18000
NOTE_WINDOW = 9000
HEADING_DIGIT_WINDOW = 1200
FEED_CHARS = 120000
MAX_UPLOADS = 15
MAX_UPLOAD_BYTES = 15 * 1024 * 1024
CATEGORY_CAPS = {"annual_report": 3, "concall": 8, "credit_rating": 5, "announcement": 20}
DEFAULT_CATEGORY_CAP = 10
DAILY_CAPS = {"openai": 1000000, "groq": 900, "mistral": 500, "gemini": 1400, "nvidia": 400}
DEFAULT_DAILY_CAP = 300
RETIRE_AFTER = 8

# --- page markers ---------------------------------------------------------------------------
PAGE_MARKER = r"=====\s*PAGE\s+(\d+)\s*====="
STATEMENT_NAME = r"(?i)financ|balance|profit|p&l|cash.?flow|\bcfs\b|\bfs\b|provisional|statement"
COMPANY_PAGE = r'id="top-ratios"|id="profit-loss"|class="company-profile"|class="company-info"'

# --- labels of statement rows ---------------------------------------------------------------
ROW = {
    "cash_from_operations": r"(?i)operating activit|cash (generated |flow )?from operat|net cash (flow )?from operat",
    "profit": r"(?i)net profit|profit after tax|profit for the (year|period)",
    "operating_profit": r"(?i)operating profit",
    "depreciation": r"(?i)depreciation",
    "other_income": r"(?i)other income",
    "profit_before_tax": r"(?i)profit before tax|\bpbt\b",
    "tax_rate": r"(?i)tax\s*%",
    "debtor_days": r"(?i)debtor days",
    "working_capital_days": r"(?i)working capital days",
    "dividend_payout": r"(?i)dividend payout",
    "borrowings": r"(?i)borrowing",
    "equity_capital": r"(?i)equity (share )?capital|share capital",
    "reserves": r"(?i)reserve",
    "revenue": r"(?i)\b(sales|revenue|total income|net sales|revenue from operations)\b",
    "promoters": r"(?i)promoter",
    "pledged": r"(?i)pledge",
    "debt_to_equity": r"(?i)debt\s*to\s*equity|d/e",
}

# --- item kind ------------------------------------------------------------------------------
QUALITATIVE_HINTS = [
    "text", "categor", "yes/no", "yes / no", "yes-no", "boolean", "narrative", "descript",
    "qualitative", "commentary", "free text", "free-text",
]
NUMERIC_HINTS = [
    "%", "percent", "ratio", "₹", "rs.", "rs ", "inr", "rupee", "crore", "lakh", "count", "number",
    "numeric", "integer", "amount", "d/e", "d:e", "debt-to-equity", "debt to equity", "times",
    "days", "bps", "basis point", "decimal", "multiple",
]

# --- custom numeric rules: item, green, red; else NEUTRAL -------------------------------------
# a bound is (operator, number); green needs all of its bounds, red any of them
CUSTOM_NUMERIC = {
    "A8-10": {"green": [(">=", 18), ("<=", 34)], "red": [("<", 10), (">", 45)]},
    "A8-03": {"green": [("<", 45)], "red": [(">", 150)]},
    "A8-11": {"green": [("<=", 1.35)], "red": [(">=", 2)]},
    "A14-02": {"green": [("<=", 1)], "red": [(">", 2)]},
    "A6-05": {"green": [("<", 100)], "red": [(">=", 200)]},
    "A1-04": {"green": [("<=", 0)], "red": [(">=", 2)]},
    "A1-08": {"green": [("<=", 0)], "red": [(">=", 2)]},
    "A8-05": {"green": [("<=", 20)], "red": [(">=", 45)]},
}

# --- materiality: item -> base, green at most %, red at least % --------------------------------
MATERIALITY = {
    "A5-01": ("revenue", 5, 15),
    "A5-02": ("revenue", 1, 2.5),
    "A5-03": ("net_worth", 5, 15),
    "A5-04": ("revenue", 5, 15),
    "A11-03": ("net_worth", 5, 15),
    "A7a-01": ("net_worth", 25, 50),
    "A7a-03": ("net_worth", 10, 30),
    "A7a-04": ("net_worth", 10, 30),
    "A7a-05": ("net_worth", 10, 30),
    "A7a-06": ("net_worth", 10, 25),
    "A7a-07": ("net_worth", 15, 40),
    "A7a-08": ("net_worth", 15, 40),
    "A7a-09": ("net_worth", 10, 25),
    "A7a-10": ("net_worth", 10, 30),
    "A7a-12": ("net_worth", 10, 25),
}
GUARDED_ITEMS = ["A7a-02", "A7a-11", "A7a-13", "A7a-14", "A7a-15", "A5-05", "A5-06"]
GUARD_PERCENT = 10
PLAUSIBLE_MULTIPLE = 1.5
PROFIT_MULTIPLE = 10

# --- item sets ------------------------------------------------------------------------------
LISTED_ONLY = [
    "A1-01", "A1-04", "A1-06", "A1-07", "A1-08", "A1-09", "A1-10", "A2-01", "A2-02", "A2-04",
    "A3-01", "A3-02", "A3-06", "A5-06", "A6-05", "A7-01", "A9-01", "A10-03", "A15-01", "A15-02",
    "A15-03",
]
INTEGRITY_ITEMS = ["A1-05", "A9-04", "A13-01", "A13-02", "A13-07"]
PERSON_ITEMS = ["A1-05", "A9-04", "A13-02", "A13-03", "A13-07"]
RESEARCH_ITEMS = [
    "A1-05", "A1-06", "A3-07", "A4-02", "A6-02", "A9-01", "A9-02", "A9-04", "A9-05", "A10-02",
    "A10-03", "A12-01", "A12-02", "A13-01", "A13-02", "A13-03", "A13-04", "A13-05", "A13-06",
    "A13-07", "A13-08", "A13-09", "A15-03",
]
RECENT_SECTIONS = ["A15"]
RECENT_YEARS = 2
HISTORY_YEARS = 25

# --- patterns over findings ------------------------------------------------------------------
AMOUNT_CRORE = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(?:crore|cr\b)"
FIRST_NUMBER = r"-?\d+(?:\.\d+)?"
BAND_BOUND = r"(<=|>=|<|>)\s*(\d+(?:\.\d+)?)(?:\s*-\s*(\d+(?:\.\d+)?))?"
ABSENCE = (
    r"\b(nil|none|no\s+(such|verified|adverse|material|prior|external|other|known|reported|"
    r"disclosed|evidence|record|history|track)\b|not\s+(found|identified|available|disclosed|"
    r"established)|no\s+\w+\s+(found|identified|reported|established))\b"
)
DATA_GAP = (
    r"\b(not available|not disclosed|no data|could not|unavailable|no information|not found|"
    r"unable to)\b"
)
NIL_WORD = r"\b(nil|none|not applicable|no such)\b"
EXPOSURE = (
    "related[- ]?part|rpt|contingent|outstanding|guarantee|loan|advance|goodwill|pledg|litigation|"
    "claim|dispute|off[- ]balance|transaction|exposure|material"
)
NO_EXPOSURE = r"\bno\b[\w\s-]{0,24}(" + EXPOSURE + ")"
ZERO_EXPOSURE = r"\bzero\b[\w\s-]{0,24}(" + EXPOSURE + ")"
ZERO_AMOUNT = r"(?:^|[^\d.])(?:₹|rs\.?|inr)?\s*0(?:\.0+)?\s*(?:crore|cr\b|lakh)"
DISTRUST = r"(?i)implausibly large|extraction distrusted|likely a misread|downgraded from"

COUNT_OF_TOTAL = r"(?i)(\d+)\s*(?:of|out of|/)\s*(\d+)"
PERCENT_VALUE = r"(\d+(?:\.\d+)?)\s*%"
MET_TIMES = r"(?i)met\s+(\d+)\s+times"
N_MEETINGS = r"(?i)(\d+)\s+meetings?"

CHEAP_TERMS = (
    "preferential allotment|preferential issue|preferential basis|preferential|warrant|"
    "at a discount|discounted|below market|at a price lower|cheap equity"
)
CHEAP_DENIED_BEFORE = r"\b(no|nil|none|not|without|zero)\b[\w\s,/&()-]{0,32}(" + CHEAP_TERMS + ")"
CHEAP_DENIED_AFTER = (
    "(" + CHEAP_TERMS + r")[\w\s,/&()-]{0,20}\b(nil|none|not (issued|applicable|made))\b"
)
CHEAP_CLEAN = r"\b(no preferential|not issued|no warrants|at[ -]market|no cheap|no discounted)\b"
CHEAP_INSIDER = r"\b(promoter|insider|related part|key managerial|kmp)"
CHEAP_MENTION = r"\b(" + CHEAP_TERMS + ")"

OPINION_MODIFIED = r"\b(qualified opinion|adverse opinion|disclaimer of opinion)\b"
OPINION_BOILERPLATE = (
    r"\b(we are required to|we conclude on|auditor.?s responsibilit|going concern basis of "
    r"accounting|based on the audit evidence obtained)\b"
)
OPINION_GOING_CONCERN = "going concern"
OPINION_DOUBT = (
    r"\b(draw attention|significant doubt|may (not )?(be able to )?continue|material uncertainty "
    r"(exists|related to))\b"
)
OPINION_CLEAN = (
    r"\b(unmodified|unqualified|true and fair|present(s|ed)? fairly|clean opinion|in our opinion|"
    r"without (any )?qualification)\b"
)
OPINION_CONTEXT = r"\b(audit|auditor|opinion|financial statements|report of the)\b"

ROLES_COMBINED = (
    r"\b(same person|combined|chairman (cum|and) managing director is the same|no separation|"
    r"chairman.{0,30}also.{0,20}(ceo|managing director))\b"
)
ROLES_SPLIT = (
    r"\b(roles? (are )?(split|separate)|separation of (the )?roles|(chairman|chair) and (managing "
    r"director|md|ceo) are (different|separate)|different persons?|non[ -]executive chair)\b"
)

GOODWILL_NONE = r"\bno goodwill\b|goodwill[^.]{0,20}\b(nil|none|no impair)"
GOODWILL_PURCHASE = (
    r"\b(purchas|addition|acquir|bought|capital expenditure|capex|invest(?:ing|ment) in)"
)
GOODWILL_IMPAIRED = r"\bimpair"
GOODWILL_WRITTEN_DOWN = r"\b(written|write)[ -]?(down|off)\b"

# --- names, hosts, research -------------------------------------------------------------------
HONORIFIC = r"(?i)^(mr|ms|mrs|dr|capt|shri|smt|prof)\.?\s+"
NAME_STOPWORDS = [
    "limited", "ltd", "services", "service", "company", "corporation", "corp", "industries",
    "india", "indian", "group", "holdings", "enterprises", "the",
]
CORPORATE_FORMS = (
    r"\b(private|limited|ltd|holdings|pvt|incorporated|inc|corporation|corp|company|co)\b"
)
COMPANY_MENTION = (
    r"((?:[A-Z][A-Za-z0-9&.]*\s+){1,4}(?:Private\s+Limited|Pvt\.?\s*Ltd\.?|Holdings\s+Limited|"
    r"Holdings\s+Ltd\.?|Holdings|Limited|Ltd\.?|Incorporated|Inc\.?|Corporation|Corp\.?))"
)
BLOCKED_HOSTS = [
    "facebook.com", "instagram.com", "twitter.com", "x.com", "reddit.com", "quora.com",
    "pinterest.com", "tiktok.com", "youtube.com", "linkedin.com", "threads.net",
]
FILING_HOSTS = ["bseindia.com", "nseindia.com", "sebi.gov.in"]
COUNTRY_QUALIFIED = r"(?i)\bindia\b|\blimited\b|\bltd\b"
ADVERSE_TERMS = (
    "controversy OR fraud OR default OR litigation OR SEBI OR probe OR penalty OR scam"
)
FORUM_TERMS = "valuepickr forum"
PERSON_FORUM_TERMS = "promoter director valuepickr"
SOURCE_URL = r"""(?i)https?://[^\s<>"')\]]+"""

# --- wordings -------------------------------------------------------------------------------
LISTED_ONLY_VERDICT = (
    "Not applicable — this is a listed-company / market disclosure; the company is unlisted."
)
EXPECTED_NA_VERDICT = "Expected NA — not disclosed in filings; this is a web/market-data item."
MISSING_VERDICT = "Not available — no supporting evidence found."
WEB_NOTE = " (Web-sourced — low confidence; corroborate against filings/primary sources.)"
ABSENCE_NOTE = (
    "No adverse record surfaced in the searches run. Held NEUTRAL (not GREEN) because this is the "
    "ABSENCE of an adverse record, not an independently confirmed clean one — a news/web search "
    "can miss history. Corroborate against news / Valuepickr / MCA / court & tribunal records "
    "before relying on a clean track record."
)

# reasons shown with a flag; {names} are filled from the row
REASONS = {
    "committee_unclear": "Audit committee composition not clearly quantified — not flagged ({value}).",
    "committee_minority": "Audit committee is not majority-independent ({share}) — non-compliant.",
    "committee_meetings": "Audit committee met only {meetings} times (<4 required) — non-compliant.",
    "committee_good": "Audit committee is {share} (≥2/3, SEBI-compliant){met}.",
    "committee_between": "Audit committee is {share} — majority but below the 2/3 independence norm.",
    "cheap_none": "No preferential/discounted issuance to insiders disclosed ({value}).",
    "cheap_issued": "Preferential/discounted equity or warrants issued to insiders/promoters ({value}).",
    "cheap_unclear": "No discounted insider/promoter issuance identified ({value}).",
    "opinion_modified": "Modified audit opinion / going-concern emphasis ({value}).",
    "opinion_clean": "Clean/unmodified audit opinion ({value}).",
    "opinion_nothing": (
        "No qualification, adverse opinion or going-concern emphasis identified — clean opinion ({value})."
    ),
    "opinion_unclear": "Audit opinion not clearly established ({value}).",
    "roles_combined": "Chairman and MD/CEO roles are combined ({value}).",
    "roles_split": "Chairman and MD/CEO roles are separated ({value}).",
    "roles_unclear": "Chairman–MD separation not clearly established ({value}).",
    "goodwill_none": "No goodwill / no impairment reported ({value}).",
    "goodwill_purchase": (
        "The figure is a purchase/addition of assets (capital expenditure), not a goodwill impairment "
        "— no impairment identified ({value})."
    ),
    "goodwill_impaired": "Goodwill impairment identified in the accounts ({value}).",
    "goodwill_unclear": "No clear goodwill impairment identified ({value}).",
    "amount_nil": "Nil / none reported — no material exposure ({value}).",
    "amount_unread": "No amount could be read from the note — materiality unverified; not flagged.",
    "amount_no_scale": "{amount} found, but company size is unavailable — materiality unverified.",
    "amount_implausible": (
        "{amount} is implausibly large vs {base} — extraction distrusted (likely a misread); not flagged."
    ),
    "amount_no_base": "{amount} found, but {base} is unavailable — materiality unverified.",
    "amount_material": "Material — {amount} ≈ {pct}% of {base} (≥{limit}% red band).",
    "amount_immaterial": "Immaterial — {amount} ≈ {pct}% of {base} (≤{limit}%).",
    "amount_moderate": "Moderate — {amount} ≈ {pct}% of {base}.",
    "guard_implausible": "{amount} is implausibly large — extraction distrusted; downgraded from RED.",
    "guard_immaterial": "Figure is immaterial — {amount} ≈ {pct}% of net worth (<10%); downgraded from RED.",
    "band_green": '{n} meets the green band "{green}".',
    "band_red": '{n} meets the red band "{red}".',
    "band_both": '{n} matches both the green ("{green}") and red ("{red}") bands — needs review.',
    "band_neither": '{n} is between the green ("{green}") and red ("{red}") bands.',
    "days_incomplete": "Working-capital-days history is incomplete — trend not established.",
    "days_negative": (
        "Working-capital days are negative ({span}) — the company is funded by supplier/customer float (favourable)."
    ),
    "days_low": "Working-capital days remain low ({span}, {delta} days) — cash conversion is not deteriorating.",
    "days_low_sharp": (
        "Working-capital days rose sharply ({span}, {delta} days) — cash increasingly tied up in working capital."
    ),
    "days_low_rose": "Working-capital days rose ({span}, {delta} days).",
    "days_stable": "Working-capital days are stable/improving ({span}) — cash conversion is not deteriorating.",
    "days_sharp": (
        "Working-capital days rose sharply ({span}, +{change}%) — cash increasingly tied up in working capital."
    ),
    "days_rose": "Working-capital days rose modestly ({span}, +{change}%).",
    "dividend_missing": "Dividend-payout history is not available — not flagged.",
    "dividend_steady": "Consistent dividend payout — paid in all of the last {n} years (latest {latest}%).",
    "dividend_none": (
        "No dividend in the last {n} years — fine if reinvesting for growth, but no cash returned to minorities."
    ),
    "dividend_erratic": "Erratic dividend payout — paid in {paid} of the last {n} years (latest {latest}%).",
    "no_evidence": "No evidence available.",
    "no_opinion": "Judge unavailable ({why}).",
    "red_disputed": (
        "RED not confirmed on cross-check ({provider} said {flag}) — downgraded to NEUTRAL for review. "
        "Original: {reason}"
    ),
    "red_unchecked": "RED could not be cross-checked — needs review. Original: {reason}",
}

# reasons of the custom numeric rules: green, red, neutral
CUSTOM_REASONS = {
    "A8-10": (
        "Effective tax rate {n}% is near the ~25% statutory rate.",
        "Effective tax rate {n}% deviates sharply from the ~25% statutory rate.",
        "Effective tax rate {n}% is somewhat off the ~25% statutory rate.",
    ),
    "A8-03": (
        "Debtor days {n} — fast collection, little >6-month ageing (DSO proxy).",
        "Debtor days {n} — slow collection, likely significant >6-month receivables (DSO proxy).",
        "Debtor days {n} — moderate collection period (DSO proxy for >6-month ageing).",
    ),
    "A8-11": (
        "Cash EPS ≈ accounting EPS (ratio {n}); earnings not reliant on heavy non-cash add-backs.",
        "Wide cash-vs-accounting EPS gap (ratio {n}); large non-cash add-backs.",
        "Moderate cash-vs-accounting EPS gap (ratio {n}).",
    ),
    "A14-02": (
        "Modest leverage — D/E {n} (Tier-1); debt level is conservative.",
        "High leverage — D/E {n} (Tier-1).",
        "Moderate leverage — D/E {n} (Tier-1).",
    ),
    "A6-05": (
        "CEO-to-median pay ratio {n}x is within a reasonable range (extreme only above ~100–200x).",
        "CEO-to-median pay ratio {n}x is extreme and hard to justify (>200x).",
        "CEO-to-median pay ratio {n}x is elevated (100–200x) — reasonable only if clearly justified.",
    ),
    "A1-04": (
        "All independent directors appear genuinely independent — no disqualifying tenure, ties or fee-dependence.",
        "{n} “independent” directors are not genuinely independent (long tenure / ex-employee / promoter ties / "
        "fee dependence) — board independence is compromised.",
        "1 independent director carries an independence concern — worth review; see the per-director breakdown.",
    ),
    "A1-08": (
        "Every competency the board identified is covered by at least one director — no skill gaps.",
        "{n} board-identified competencies are not covered by any director — visible skill gaps.",
        "One identified competency is not covered by any director — a minor skill gap to review.",
    ),
    "A8-05": (
        "Other income is {n}% of PBT — profit is operations-led, not propped by non-operating income.",
        "Other income is {n}% of PBT — a large share of profit is non-operating (earnings-quality concern).",
        "Other income is {n}% of PBT — a moderate non-operating share of profit.",
    ),
}
