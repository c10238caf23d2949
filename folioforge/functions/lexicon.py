"""Word and phrase lists that decide results. Order is part of the value where first match wins."""

KNOWN_TITLES = (
    "COAL IMPORT", "COAL IMPORTS", "COAL AND LIGNITE PRODUCTION", "LIGNITE PRODUCTION", "LIGNITE DISPATCH", "COAL DISPATCH", "COAL DESPATCH",
    "COAL OFF-TAKE", "COAL OFFTAKE", "SECTOR-WISE COAL", "SECTOR WISE COAL", "SECTOR-WISE DEMAND", "SECTOR WISE DEMAND", "SECTOR-WISE OFFTAKE",
    "SECTOR WISE OFFTAKE", "COMPANY WISE COAL DISPATCH", "COMPANY-WISE COAL DISPATCH", "PRODUCTION STATUS", "PRODUCTIVITY IN", "OUTPUT PER MANSHIFT",
    "OUTPUT PER MAN SHIFT", "OBR DURING", "OBR UPT O", "OBR UPT", "TOTAL OBR", "DEPARTMENTAL OBR", "CONTRACTUAL OBR", "MODE-WISE DESPATCH",
    "MODE WISE DESPATCH", "MODE-WISE DISPATCH", "MODE WISE DISPATCH", "CAPITAL EXPENDITURE", "NAME OF EXPENDITURE", "HEAD-WISE CAPITAL EXPENDITURE",
    "HEAD WISE CAPITAL EXPENDITURE", "POWER SALES", "POWER GENERATION", "PRODUCTION OF POWER", "SOURCE-WISE POWER", "TOTAL MANPOWER", "MANPOWER OF CIL",
    "AGE-WISE DEBTORS", "AGE WISE DEBTORS", "DEBTORS DUE", "DEBTORS DUES", "TOTAL DEBTORS", "VENDIBLE COAL STOCK", "PORT-WISE", "PORT WISE",
    "COUNTRY-WISE", "COUNTRY WISE", "GRADE-WISE", "GRADE WISE", "AVERAGE PRICE OF IMPORTED", "SECTOR WISE COAL AND COKE IMPORT", "HEMM UTILISATION",
    "HEMM UTILIZATION",
)
#: Two titles that share one of these are one table going on.
SAME_TABLE = ("obr", "coal dispatch", "despatch", "production")
HEADER_WORDS = (
    "year", "company", "sector", "subsidiary", "actual", "target", "achievement", "total", "growth", "figure", "fig.", "quantity", "qty", "production",
    "dispatch", "despatch", "expenditure", "power", "coal", "lignite", "rate", "product", "month", "upto", "upto january", "during", "jan", "january",
    "apr", "march", "financial year", "grade", "port", "country", "price", "value", "manpower", "departmental", "contractual", "coking", "non-coking", "stock",
)
CONTINUATION_WORDS = (
    "during", "upto", "up to", "all figures", "all figur", "in mt", "in lakh", "in mm", "in cr", "in mu", "fig.", "fig in", "figure", "growth", "actual",
    "target", "achievement", "jan'", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
ROW_WORDS = ("grand total", "total", "big mines", "other mines", "big plus mines", "rest of mines", "captive/others", "power utilities", "cpp")
COMPANY_CODES = ("CIL", "ECL", "BCCL", "CCL", "NCL", "WCL", "SECL", "MCL", "SCCL")
TOPIC_STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "were", "was", "are", "been", "being", "have", "has", "had", "will", "would", "could", "should",
    "shall", "may", "might", "can", "not", "but", "than", "then", "into", "onto", "over", "under", "between", "among", "during", "through", "about", "after",
    "before", "above", "below", "within", "without", "also", "such", "their", "there", "these", "those", "they", "them", "which", "where", "when", "what",
    "whose", "while", "each", "both", "other", "more", "most", "some", "any", "all", "only", "same", "very", "per", "etc", "report", "reports", "page",
    "pages", "table", "tables", "source", "sources", "note", "notes", "figure", "fig", "figures", "chart", "charts", "section", "chapter", "appendix", "data",
    "details", "information", "statement", "statements", "total", "value", "values", "year", "years", "month", "months", "date", "dates", "january",
    "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "mtd", "ytd", "upto", "nos", "no", "nil",
    "na", "figs", "mt", "fy", "crore", "crores", "lakh", "lakhs", "rs", "inr", "government", "ministry", "department", "office", "authority", "official",
    "regarding", "following", "provided", "given", "based", "including", "according", "respectively",
)
GENERIC_TOPICS = (
    "information", "details", "statement", "document", "reporting", "analysis", "result", "results", "description", "general", "particular", "provided", "available",
)
CLOUD_STOP_WORDS = (
    "the", "and", "of", "to", "in", "for", "on", "a", "an", "is", "are", "was", "were", "be", "by", "with", "from", "as", "at", "or", "this", "that", "these",
    "those", "it", "its", "has", "have", "had", "not", "but", "than", "into", "during", "through", "over", "under", "about", "which", "their", "there", "been",
    "being", "also", "such", "may", "can", "will", "would", "should", "per", "no", "yes",
)
KEY_INFORMATION_WORDS = (
    "production", "coal", "lignite", "revenue", "output", "target", "growth", "achievement", "capacity", "million", "mt", "crore", "percentage",
)
UPLOAD_TYPES = ("pdf", "docx", "xlsx", "xls", "csv", "png", "jpg", "jpeg")
#: The whole lines, once trimmed, that are left-overs of charts.
CHART_FRAGMENTS = (r"[Ss]\s+is", r"é\s*=\s*\d+", r"sin\s+MT", r"In\s+MT", r"No\s+of", r"[a-zA-Z]\s*[=>]+\s*[-_]+")
