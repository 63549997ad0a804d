"""The patterns and phrases that the rules name."""

HEADING = [
    r"^\s*Question[- ]and[- ]Answer Session\s*$",
    r"^\s*Questions and Answers\s*$",
    r"^\s*Question and Answer Session\s*$",
    r"^\s*Question and Answer\s*$",
    r"^\s*Q&A Session\s*$",
    r"^\s*Q&A\s*$",
    r"^\s*Analyst Q&A\s*$",
]
MANAGEMENT = [
    r"(?:with that|and with that),?\s+(?:we will|we'll|let's|let us)\s+(?:now\s+)?(?:open|begin|start|move to|move into)\s+(?:the call\s+)?(?:for|to)?\s*(?:questions|q&a)",
    r"(?:with that|and with that),?\s+(?:I will|I'll)\s+(?:now\s+)?(?:turn|hand)\s+(?:the call\s+)?(?:back\s+)?(?:over\s+)?(?:to\s+)?(?:the\s+)?operator\s+(?:for|to)\s+(?:questions|q&a)",
    r"(?:we will|we'll|let's|let us)\s+(?:now\s+)?(?:open|begin|start|move to|move into)\s+(?:the call\s+)?(?:for|to)?\s*(?:questions|q&a)",
    r"(?:we are|we're)\s+(?:now\s+)?ready\s+(?:to take|for)\s+(?:your\s+)?questions",
    r"(?:operator),?\s+(?:we are|we're)\s+ready\s+(?:to take|for)\s+(?:your\s+)?questions",
    r"(?:operator),?\s+(?:please open|please begin|please poll)\s+(?:the line|the call|the lines)\s+(?:for|to)\s+(?:questions|q&a)",
    r"(?:operator),?\s+(?:may we have|can we have|please provide)\s+(?:the first question|our first question)",
    r"(?:may we have|can we have)\s+(?:the first question|our first question),?\s+please",
    r"(?:after that|afterwards),?\s+(?:we will|we'll)\s+open\s+(?:the call\s+)?(?:to|for)\s+(?:questions|q&a)",
    r"(?:we will|we'll)\s+then\s+(?:open|begin|start)\s+(?:the call\s+)?(?:for|to)\s+(?:questions|q&a)",
    r"(?:that concludes|this concludes)\s+(?:our\s+)?(?:prepared remarks|formal remarks)",
]
_SAYS = r"Operator\s*:\s*(?:Thank you\.?\s*)?(?:Certainly\.?\s*)?"
OPERATOR = [
    _SAYS + r"(?:Our first question|The first question|First question)",
    _SAYS + r"(?:We'll take|We will take|We'll go ahead and take|We will go ahead and take)\s+our\s+first\s+question",
    _SAYS + r"(?:And our first question|Your first question)",
    _SAYS + r"(?:The question comes from|Our next question comes from)",
    _SAYS + r"(?:We will now|We'll now|At this time, we will|At this time, we'll|We are now going to)\s+(?:begin|open|start|take)\s+(?:the )?(?:question-and-answer|question and answer|Q&A|questions)",
    _SAYS + r"(?:If you would like to ask a question|To ask a question)",
    _SAYS + r"(?:Ladies and gentlemen),?\s+(?:we will now|we'll now)\s+(?:begin|open|start)\s+(?:the )?(?:question-and-answer|Q&A|questions)",
]
ANALYST = [
    r"(?:Our first question|The first question|First question)\s+(?:comes|is)\s+from\s+",
    r"(?:We'll take|We will take|We'll go ahead and take|We will go ahead and take)\s+our\s+first\s+question\s+from\s+",
    r"(?:Your first question)\s+(?:comes|is)\s+from\s+",
    r"(?:Next question|Our next question)\s+(?:comes|is)\s+from\s+",
]
TURN = r"(?im)(?:^|\n)\s*Operator\s*(?::|-)\s*"
#: Method, confidence, pattern.
DETECTORS = [
    ("explicit_q_and_a_heading", 0.99, "(?im)" + "|".join(f"(?:{p})" for p in HEADING)),
    ("management_qa_transition", 0.96, "(?i)" + "|".join(f"(?:{p})" for p in MANAGEMENT)),
    ("operator_qa_phrase", 0.94, "(?i)" + "|".join(f"(?:{p})" for p in OPERATOR)),
    ("first_analyst_question_like_pattern", 0.70, "(?i)" + "|".join(f"(?:{p})" for p in ANALYST)),
]
LATE, SECOND = ("late_operator_intervention_fallback", 0.65), ("second_operator_intervention_fallback", 0.55)
MENTION = r"(?i)question-and-answer|question and answer|questions and answers|q&a"
CLOSING = r"(?i)this concludes|conference has now concluded|you may now disconnect|thank you for joining|thank you for your participation|end of (?:today'?s )?conference"
TRUNCATION = r"(?i)\[truncated\]|\(truncated\)|\.\.\.\s*$|content truncated|output truncated|continued in next chunk|continued on next page|transcript ends|audio ends|call ends abruptly"
UNFINISHED = ["let me now take you through", "let me take you through", "i will now take you through", "i'll now take you through", "turn the call", "turn it over", "with that,", "moving to", "starting with"]
FINISHED = r"(?i)[.!?]\"?$|disconnect your lines\.?$|conclude.*call\.?$"
QUESTION, ANSWER = r"(?i)\b(?:question|analyst|operator)\b", r"(?i)\b(?:answer|ceo|cfo|chief|president|officer|management)\b"

RELEVANT_FORMS = ["8-K", "6-K", "10-Q", "10-K", "20-F", "40-F"]
EARNINGS_LIKE = r"(?i)earnings|results|release|exhibit|ex-99|exhibit 99"
LIKELY_EARNINGS = [
    "financial results", "earnings", "results for the quarter", "quarter ended", "three months ended",
    "reports first quarter", "reports second quarter", "reports third quarter", "reports fourth quarter",
    "announces first quarter", "announces second quarter", "announces third quarter", "announces fourth quarter",
]
LITIGATION = ["class action", "lawsuit", "investor alert", "shareholder alert", "investigation"]
QUARTER_WORDS = ["first", "second", "third", "fourth"]
EARNINGS_RELEASE = r"(?i)earnings|results|press release|news release|financial results|quarterly results|ex-99|exhibit\s*99|item\s*2\.02"
#: Words in lower case of which a text that matches holds one at least.
RELEASE_WORDS = ["earnings", "results", "press release", "news release", "ex-99", "exhibit", "item"]
RESULTS_ITEM = r"(?i)\b2\.02\b|results of operations|financial condition"
RESULTS_WORDS = ["2.02", "results of operations", "financial condition"]
LEGAL_EXHIBIT = (
    r"(?i)credit agreement|loan agreement|revolving credit|cusip|lenders|administrative agent|syndication agent|joint lead arranger|bookrunner|"
    r"article\s+i\.?\s+definitions|borrower|guarantor|indenture|lease agreement|employment agreement|separation agreement|purchase agreement|"
    r"merger agreement|bylaws|certificate of amendment|execution version"
)
#: Words in lower case of which a text that matches holds one at least.
LEGAL_WORDS = [
    "agreement", "revolving credit", "cusip", "lenders", "agent", "joint lead arranger", "bookrunner", "definitions", "borrower", "guarantor", "indenture", "bylaws",
    "certificate of amendment", "execution version",
]

# What tables of releases are told apart by.
CURRENCY = ["$", "€", "£", "¥"]
PERIOD_LABELS = [
    "three months ended", "six months ended", "nine months ended", "twelve months ended", "year ended", "years ended", "quarter ended", "months ended",
    "march 31", "june 30", "september 30", "december 31", "january 31", "april 30", "july 31", "october 31",
]
#: On the path of releases only ends of calendar quarters count.
RELEASE_PERIOD_LABELS = [
    "three months ended", "six months ended", "nine months ended", "twelve months ended", "year ended", "years ended", "quarter ended", "months ended",
    "march 31", "june 30", "september 30", "december 31",
]
RELEASE_LONG_DATE = r"(?i)(March|June|September|December)\s+\d{1,2},\s+\d{4}"
LONG_DATE = r"(?i)(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}"
SECTION_LABELS = [
    "assets", "current assets:", "current assets", "liabilities and stockholders' equity", "liabilities and shareholders' equity", "current liabilities:", "current liabilities",
    "stockholders' equity:", "shareholders' equity:", "cash flows from operating activities:", "cash flows from investing activities:", "cash flows from financing activities:",
    "net income per share:", "weighted average shares outstanding:",
]
STATEMENTS = [
    "statement of operations", "statements of operations", "statement of income", "statements of income", "statement of earnings", "balance sheet", "balance sheets",
    "statement of cash flows", "statements of cash flows", "consolidated statement", "consolidated statements", "condensed consolidated",
]
NON_GAAP = [
    "non-gaap", "reconciliation", "adjusted ebitda", "adjusted net income", "adjusted diluted earnings per share", "adjusted eps", "free cash flow", "affo", "ffo", "ebitda",
]
CONTACTS = ["investors", "media", "investor relations", "corporate communications"]

# Rows that make a table of a release financial, and words that tell tables apart there.
ROW_SIGNALS = [
    "total assets", "current assets", "cash and cash equivalents", "accounts receivable", "property and equipment", "inventory", "total liabilities",
    "stockholders' equity", "shareholders' equity", "total equity", "net sales", "revenues", "revenue", "operating revenues", "gross profit",
    "operating income", "operating loss", "net income", "net loss", "income before provision", "weighted average shares", "earnings per share",
    "net cash provided by operating activities", "net cash used in operating activities", "cash flows from operating activities",
    "cash flows from investing activities", "cash flows from financing activities", "capital expenditures",
]
RELEASE_STATEMENTS = [
    "statement of operations", "statements of operations", "statement of income", "statements of income", "statement of earnings", "statements of earnings",
    "statement of loss", "statements of loss", "balance sheet", "balance sheets", "statement of cash flows", "statements of cash flows",
    "consolidated statement", "consolidated statements", "condensed consolidated",
]
RELEASE_NON_GAAP = [
    "non-gaap", "reconciliation", "adjusted ebitda", "adjusted net income", "adjusted diluted earnings per share", "adjusted earnings per share", "adjusted eps",
    "free cash flow", "funds from operations", "affo", "ffo", "ebitda",
]
ADJUSTED = ["adjusted", "non-gaap", "reconciliation"]
# Lines of a page that are no part of a release.
BOILERPLATE = ["news provided by", "explore", "more news releases in similar topics", "contact cision", "products", "about", "my services"]
BOILERPLATE_STARTS = ["view original content", "source "]
# What a line of a table in plain text looks like.
TABLE_NUMBERS = r"[\$,\(\)%]|\b20\d{2}\b|\b\d+\.\d+\b|\b\d{1,3}(?:,\d{3})+\b"
#: A sign of which a line with such a number holds one at least; the words of a table, in lower case.
TABLE_SIGNS = r"[$,()%0-9]"
TABLE_WORD_LIST = ["revenue", "income", "loss", "assets", "liabilities", "cash", "shares", "ebitda", "expenses", "operations"]
TABLE_SPACING = r"\S\s{2,}\S"
TABLE_WORDS = r"(?i)revenue|income|loss|assets|liabilities|cash|shares|ebitda|expenses|operations"
# Exhibits by what they say.
EXHIBIT_99 = r"(?i)ex[-_ ]?99|exhibit\s*99"
FIRST_EXHIBIT = r"(?i)(?:^|[_\-.])ex[-_]?99[_\-.]?1(?:\D|$)|exhibit\s*99\.1"
LATER_EXHIBIT = r"(?i)(?:^|[_\-.])ex[-_]?99[_\-.]?[2-9](?:\D|$)|exhibit\s*99\.[2-9]"
POSITIVE_TERMS = (
    r"(?i)financial results|quarterly results|full year|total revenue|net income|diluted share|revenue comparison|cost of materials|"
    r"consolidated balance sheets|consolidated statements|statements of income|statements of cash flows|cash flows|guidance"
)
#: The same, asked only where one of their first letters stands.
POSITIVE_SEARCH = f"(?i)(?=[cdfgnqrst])(?:{POSITIVE_TERMS.removeprefix('(?i)')})"
CAPITAL_RETURN = r"(?i)share repurchase authorization|repurchase program|quarterly cash dividend|10b5-1|rule 10b-18"
CAPITAL_WORDS = ["repurchase", "quarterly cash dividend", "10b5-1", "rule 10b-18"]
# Where publishers put the release in a page, by part of the domain; tag and class, in the order tried.
CONTAINERS = {
    "prnewswire.com": ["section.release-body", "div.release-body", "article", "main"],
    "globenewswire.com": ["div.main-container", "article", "main"],
    "businesswire.com": ["div.bw-release-story", "article", "main"],
    "": ["article", "main", "div.release-body", "section.release-body"],
}
PAGE_NOISE = ["script", "style", "noscript", "iframe", "svg", "form", "nav", "footer", "header"]
