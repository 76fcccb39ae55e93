"""Where the evidence of each item is looked for.

Plain lists of headings and words. A deployment with another checklist passes its own tables by
assigning BY_ITEM, BY_SECTION and WEB_TOPICS before routing.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Strategy:
    source: str = "document"
    metric: str | None = None
    doc_types: tuple[str, ...] = ("ANNUAL_REPORT",)
    headings: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    note_mode: bool = False
    web_topic: str | None = None


def _metric(name: str) -> Strategy:
    return Strategy("structured", name, ())


# items read or computed from the period tables
BY_ITEM: dict[str, Strategy] = {
    "A14-01": _metric("debt_to_equity"),
    "A14-02": _metric("debt_to_equity"),
    "A3-01": _metric("promoters"),
    "A3-02": _metric("pledged"),
    "A3-06": _metric("free_float"),
    "A8-01": _metric("cash_to_profit"),
    "A8-12": _metric("cash_to_operating_profit"),
    "A8-10": _metric("tax_rate"),
    "A8-03": _metric("debtor_days"),
    "A8-11": _metric("cash_eps"),
    "A8-02": _metric("working_capital_days"),
    "A8-05": _metric("other_income_pct"),
    "A10-01": Strategy(
        "structured", "dividend_payout", ("ANNUAL_REPORT",),
        headings=("dividend distribution policy", "dividend", "directors' report"),
        keywords=("dividend", "payout", "per equity share", "final dividend", "interim dividend", "dividend declared"),
    ),
    # items read from documents
    "A1-01": Strategy(
        keywords=("independent director", "composition of the board", "board of directors", "non-executive", "executive director", "woman director"),
    ),
    "A1-04": Strategy(
        headings=("corporate governance", "brief profile of the directors", "profile of directors", "board of directors", "composition of the board", "remuneration of directors", "sitting fees"),
        keywords=("independent director", "tenure", "date of appointment", "sitting fees", "commission", "former employee", "related party", "years"),
        note_mode=True, web_topic="independent directors true independence tenure ex-employee promoter ties",
    ),
    "A1-06": Strategy(
        headings=("directorships in other companies", "number of directorships", "other directorships", "directorship in other listed", "directorships held in other", "composition of the board", "board of directors"),
        keywords=("directorship", "other companies", "committee membership", "other listed entities", "director", "chairperson"),
        note_mode=True, web_topic="directors number of other listed company board seats overboarding",
    ),
    "A1-07": Strategy(
        headings=("attendance of directors", "attendance at board meetings", "board meeting attendance", "number of board meetings and attendance", "attendance of each director", "director attendance record"),
        keywords=("attendance", "board meetings held", "meetings attended", "director", "last annual general meeting", "no. of board meetings"),
        note_mode=True, web_topic="board meeting attendance record of directors",
    ),
    "A1-08": Strategy(
        headings=("skills / expertise / competencies", "chart of the skills", "matrix of skills", "core skills", "skills and competencies", "list of core skills", "skills, expertise and competencies"),
        keywords=("skill", "competenc", "expertise", "matrix", "identified by the board", "chart"),
        note_mode=True,
    ),
    "A2-01": Strategy(
        headings=("audit committee", "composition of the audit committee", "audit committee comprises", "audit committee of the board"),
        keywords=("audit committee", "independent director", "met", "meetings", "attendance", "chairperson", "members"),
        note_mode=True,
    ),
    "A3-04": Strategy(
        headings=("rights, preferences and restrictions", "terms/rights attached to equity shares", "rights attached to equity shares", "equity share capital", "share capital"),
        keywords=("one vote", "per share", "voting rights", "equity shares of", "ordinary shares", "differential voting"),
    ),
    "A3-05": Strategy(
        headings=("share capital", "changes in equity share capital", "reconciliation of the number of shares", "preferential issue", "employee stock"),
        keywords=("preferential allotment", "warrants", "at a discount", "bonus issue", "rights issue", "preferential basis", "employee stock option"),
    ),
    "A4-01": Strategy(
        keywords=("statutory auditor", "auditor's report", "chartered accountants", "appointed as auditors", "re-appointment of auditor", "rotation of auditor"),
    ),
    "A4-06": Strategy(
        headings=("payments to the auditor", "payment to auditors", "auditor's remuneration", "remuneration to auditors", "payment to statutory auditor"),
        keywords=("audit fee", "statutory audit", "tax audit", "other services", "reimbursement of expenses", "limited review"),
        note_mode=True,
    ),
    "A4-07": Strategy(
        headings=("payments to the auditor", "payment to auditors", "auditor's remuneration", "remuneration to auditors", "payment to statutory auditor"),
        keywords=("audit fee", "statutory audit", "remuneration", "fees", "other services"),
        note_mode=True,
    ),
    "A6-04": Strategy(
        headings=("employee stock option", "share-based payment", "employee share-based", "stock options"),
        keywords=("stock option", "esop", "rsu", "share-based payment", "grant", "exercise price", "dilution"),
    ),
    "A6-05": Strategy(
        headings=("ratio of the remuneration of each director to the median remuneration", "ratio of remuneration of each director to the median", "the ratio of the remuneration of each director", "median remuneration of employees", "percentage increase in the median remuneration", "particulars of employees", "remuneration of directors"),
        keywords=("median remuneration", "ratio of the remuneration", "ratio to median", "median employee", "percentage increase in remuneration", "managing director", "times the median"),
        web_topic="CEO managing director remuneration to median employee ratio section 197",
    ),
    "A7-04": Strategy(
        doc_types=("EARNINGS_PDF", "ANNUAL_REPORT"),
        keywords=("guidance", "outlook", "demand", "margin", "deal", "commentary", "we expect", "management"),
    ),
    "A11-03": Strategy(
        headings=("loans, guarantees and investments", "particulars of loans", "loans given", "section 186", "investments made during the year"),
        keywords=("loan", "inter-corporate", "section 186", "guarantee", "investment in", "deposits placed"),
        note_mode=True,
    ),
    "A12-03": Strategy(
        headings=("employee stock option", "share-based payment", "stock options"),
        keywords=("stock option", "esop", "rsu", "share-based payment", "option pool"),
    ),
    "A13-02": Strategy(
        doc_types=("EARNINGS_PDF", "ANNUAL_REPORT"),
        keywords=("managing director", "chief executive", "capital allocation", "md & ceo", "return on capital"),
        web_topic="CEO capital allocation track record",
    ),
}

# sections whose items read the notes under these headings
BY_SECTION: dict[str, Strategy] = {
    "A2": Strategy(
        doc_types=(), headings=("audit committee", "nomination and remuneration committee", "stakeholders relationship committee", "corporate social responsibility committee", "risk management committee", "composition of the committees"),
        keywords=("committee", "independent", "meetings held", "attendance", "chairperson", "constituted"),
    ),
    "A3": Strategy(
        doc_types=(), headings=("share capital", "equity share capital", "rights, preferences and restrictions"),
        keywords=("one vote", "differential voting", "equity shares", "per share", "voting rights", "face value"),
    ),
    "A5": Strategy(
        doc_types=(), headings=("related party transactions", "related party disclosures", "transactions with related parties"),
        keywords=("related party", "related parties", "arm's length", "key managerial personnel", "ordinary course of business", "subsidiaries"),
        note_mode=True,
    ),
    "A6": Strategy(
        doc_types=(), headings=("nomination and remuneration policy", "remuneration of directors", "managerial remuneration", "remuneration to key managerial"),
        keywords=("remuneration", "commission", "variable pay", "performance linked", "perquisites", "sitting fees"),
    ),
    "A7a": Strategy(
        doc_types=(), headings=("contingent liabilities and commitments", "commitments and contingencies", "contingent liabilities", "claims against the company not acknowledged as debt", "contingencies", "contingent liability", "commitments"),
        keywords=("contingent", "guarantee", "claims not acknowledged as debt", "commitments", "contingencies", "disputed", "demand", "litigation"),
        note_mode=True,
    ),
    "A8": Strategy(
        doc_types=(), headings=("material accounting policies", "significant accounting policies", "property, plant and equipment", "intangible assets", "revenue recognition"),
        keywords=("capitalis", "capitaliz", "accounting policy", "amortis", "depreciation", "revenue is recognised"),
    ),
    "A11": Strategy(
        doc_types=(), headings=("investment in subsidiaries", "subsidiaries", "cash and cash equivalents", "investments"),
        keywords=("subsidiary", "subsidiaries", "dividend received", "cash and bank", "investment in", "step-down"),
    ),
    "A13": Strategy(
        doc_types=(), headings=("board of directors", "directors' report", "management discussion and analysis"),
        keywords=("promoter", "family", "succession", "managing director", "founder", "chairman"),
    ),
}

# document types of sections that do not read the annual report alone
SECTION_DOC_TYPES: dict[str, tuple[str, ...]] = {
    "A13": ("EARNINGS_PDF", "ANNUAL_REPORT"),
    "A7": ("EARNINGS_PDF", "ANNUAL_REPORT"),
    "A9": ("ANNOUNCEMENT", "ANNUAL_REPORT"),
}

# items answered by outside research, with the topic searched for; a missing answer is expected
WEB_TOPICS: dict[str, str] = {
    "A12-01": "employee attrition rate",
    "A15-03": "analyst research coverage brokerages",
    "A3-07": "marquee institutional investor stake entry exit",
    "A9-01": "SEBI order penalty consent order insider trading",
    "A4-02": "statutory auditor audit firm name reputation Big Four top national vs small local firm standing",
    "A9-04": "promoter group track record other listed companies governance record",
    "A13-01": "CEO professional management versus promoter-run company",
    "A13-03": "promoter founder background history vintage earlier ventures other businesses track record beyond this company including any failed or wound-up companies",
    "A13-04": "senior management leadership team tenure experience",
    "A13-05": "second line management bench strength key executives",
    "A13-06": "promoter family dispute succession feud shareholding",
    "A13-07": "promoter other businesses group companies interests",
    "A13-08": "company government dealings sensitive regulatory contracts",
    "A13-09": "promoter political connections affiliations",
    "A1-05": "independent director board member background legal case fraud SEBI CBI arrest bail controversy at other companies",
}
