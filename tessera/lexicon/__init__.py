"""Dictionaries that queries, sections and tables are understood by; all are parameters of the functions that use them."""

from tessera.lexicon.sections import CHUNK_SIZES, DEFAULT_WEIGHT, PROXY_NAMES, SECTION_WEIGHTS, TITLES
from tessera.lexicon.terms import ACRONYMS, SYNONYMS

#: Kind of query -> (patterns, whether they see the query as written or lower-cased). The order of the kinds, which breaks ties.
QUERY_KINDS = {
    "exact_metric": (
        [
            r"\b(revenues?|sales|profits?|income|margins?|eps|debt|cash|ebitda|earnings|expenses?|dividends?)\b",
            r"\bhow (much|many)\b",
            r"\bwhat (was|is|were)\b.*\b(total|amount|number|rate|ratio|value)\b",
            r"\$\s?\d",
            r"\d\s?(%|percent\b|million\b|billion\b)",
            r"\bq[1-4]\b",
        ],
        False,
    ),
    "entity": ([r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", r"\b(CEO|CFO|COO|CTO)\b", r"\b[A-Z]{2,5}\b", r"\b(Inc|Corp|Ltd|LLC|Holdings)\b"], True),
    "comparison": ([r"\bcompar(e|ed|ison)\b", r"\b(vs|versus)\b", r"\bdifferen(ce|t)\b", r"\b(higher|lower|better|worse|more|less) than\b", r"\brelative to\b"], False),
    "trend": ([r"\btrends?\b", r"\bover (time|the (last|past))\b", r"\b(grow|grown|growth|decline|declined|increased?|decreased?)\b", r"\b(year over year|quarter over quarter|yoy|qoq)\b", r"\bsince (19|20)\d{2}\b"], False),
    "conceptual": ([r"\b(why|how does|explain|describe|discuss)\b", r"\b(strategy|risk|risks|approach|outlook|policy)\b", r"\bwhat (are|is) the (main|key|primary)\b", r"\b(impact|effect|affect)s?\b", r"\btell (me|us) about\b"], False),
}

#: Kind of query -> share of the vector score, as results depend on them.
QUERY_WEIGHTS = {"exact_metric": 0.3, "conceptual": 0.8, "entity": 0.2, "trend": 0.6, "comparison": 0.7, "default": 0.7}

#: Kind of table -> patterns over caption and content.
TABLE_KINDS = {
    "compensation": [r"compensation", r"\bsalar(y|ies)\b", r"\bbonus(es)?\b", r"stock awards?", r"option awards?", r"\bpensions?\b", r"\bvest(ed|ing)\b"],
    "governance": [r"\bdirectors?\b", r"\bcommittees?\b", r"\bboard\b", r"\bnominees?\b", r"\bindependen(t|ce)\b", r"\bvotes?\b", r"beneficial owner(s|ship)?"],
    "financial_statement": [r"balance sheet", r"cash flows?", r"statements? of (income|operations|earnings)", r"total (assets|liabilities)", r"net income", r"stockholders'? equity", r"gross profit", r"operating expenses"],
    "metrics": [r"\bmetrics?\b", r"key (figures|performance)", r"\bkpis?\b", r"\bmargins?\b", r"\bgrowth\b", r"\bper share\b", r"\bsegments?\b"],
    "schedule": [r"\bschedules?\b", r"maturit(y|ies)", r"\bdue\b", r"\bobligations?\b", r"\bamortization\b", r"\bthereafter\b"],
    "comparison": [r"compar", r"\bprior (year|period)\b", r"\bversus\b", r"\bvs\b", r"(increase|decrease|change) (from|over)", r"\bpeer group\b", r"\byear[- ]over[- ]year\b"],
}
