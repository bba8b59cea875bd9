"""The legal pack as data: structural units, markers, definitions, references, citations, gate terms, override scopes.

Patterns are stored without flags: java() and python() add those that make both engines read them alike (Unicode classes
and, where ignore_case holds, case folding beyond ASCII).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSURE = frozenset({"exception_of", "supersedes", "amends", "conditioned_on", "defines"})


def java(pattern: str, ignore_case: bool = True) -> str:
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def python(pattern: str, ignore_case: bool = True) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE if ignore_case else 0)


@dataclass(frozen=True)
class Marker:
    name: str
    pattern: str
    edge: str
    strong: bool = True
    target: str = "preceding"
    side: str = "after"

    @property
    def confidence(self) -> float:
        return 1.0 if self.strong else 0.6

    @property
    def java(self) -> str:
        return java(self.pattern)


# Results depend on exactly these patterns and words.

#: name, pattern at a node's start, ignore case, edge type; the first that fits counts
UNITS = (
    ("proviso", r"^\s*provided\s+(?:further\s+|also\s+)?that\b", True, "exception_of"),
    ("explanation", r"^\s*Explanation\s*[\-—–.:]*\s*(?:[IVX0-9]+)?\s*[\-—–.:]", True, "defines"),
    ("illustration", r"^\s*Illustrations?\s*[\-—–.:]", True, "exemplifies"),
    ("exception", r"^\s*Exceptions?\s*(?:[IVX0-9]+)?\s*[\-—–.:]", True, "exception_of"),
    ("sub_section", r"^\s*\((\d+)\)\s+", False, "part_of"),
    ("clause", r"^\s*\(([a-z]{1,2})\)\s+", False, "part_of"),
    ("schedule", r"^\s*(?:THE\s+)?(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|[IVX]+)?\s*SCHEDULE\b", True, "part_of"),
)

MARKERS = (
    Marker("non_obstante", r"notwithstanding\s+anything\s+(?:contained\s+|to\s+the\s+contrary\s+)*(?:in|under)\b", "supersedes", True, "referenced"),
    Marker("subject_to", r"subject\s+to\s+the\s+(?:provisions\s+of|other\s+provisions)", "conditioned_on", True, "referenced"),
    Marker("save_as_provided", r"(?:save|except)\s+as\s+(?:otherwise\s+)?(?:provided|expressly\s+provided)", "exception_of", True, "referenced"),
    Marker("nothing_in_referenced_shall_apply", r"nothing\s+(?:contained\s+)?in\b(?!\s+this\b)[^;]{0,60}?(?=\s+shall\s+(?:apply|be|affect|extend|authoris|authoriz|render|entitle|prevent|operate)\w*\b)", "exception_of", True, "referenced", "within"),
    Marker("nothing_shall_apply", r"nothing\s+(?:contained\s+)?in\s+this\s+(?:section|Act|Chapter|sub-section|rule)\s+shall\s+(?:apply|extend|affect|be\s+deemed)", "exception_of"),
    Marker("unless", r"\bunless\s+(?:the\s+context|otherwise\s+(?:provided|required|expressly))", "conditioned_on", False),
    Marker("deeming", r"shall\s+be\s+deemed\s+(?:to\s+(?:be|have)|not\s+to\s+be)", "defines"),
    Marker("shall_not_apply_to", r"shall\s+not\s+apply\s+to\b", "exception_of"),
    Marker("for_the_purposes_of", r"for\s+the\s+purposes?\s+of\s+this\s+(?:section|Act|Chapter|clause|sub-section)", "defines", False, "following"),
    Marker(
        "for_the_purposes_of_referenced",
        r"for\s+the\s+purposes?\s+of\s+"
        r"(?=(?:(?:clause|item|paragraph|sub-?\s*clause)\s*\([^)]{1,6}\)\s*of\s+)?"
        r"(?:sub-?\s*sections?\s*(?:\(\s*\d{1,3}[A-Za-z]?\s*\)\s*(?:,\s*|(?:,\s*)?(?:and|or|&|to)\s*)?)+"
        r"|sections?\s*\.?\s*\d{1,4}[A-Z]{0,2}(?:\s*(?:,|and|&|or)\s*\d{1,4}[A-Z]{0,2})*)"
        r"(?:\s*and\s+this\s+\w+)?\s*[,–—-])",
        "defines", True, "referenced", "after",
    ),
    Marker("substitution", r"for\s+the\s+(?:words|figures|expression|brackets)[^,]{0,120},\s*the\s+(?:words|figures|expression)[^,]{0,120}\s+shall\s+be\s+substituted", "amends", True, "referenced", "before"),
    Marker("insertion", r"shall\s+be\s+inserted\b", "amends", True, "referenced", "before"),
    Marker("omission", r"shall\s+be\s+omitted\b", "amends", True, "referenced", "before"),
    Marker("repeal", r"\b(?:is|are|shall\s+stand)\s+hereby\s+repealed\b|\bRepeal\s+and\s+[Ss]avings?\b", "supersedes", True, "referenced", "before"),
    Marker("overruled", r"\b(?:is|are|stands?|hereby)\s+overruled\b|\bwe\s+overrule\b|\bno\s+longer\s+good\s+law\b", "supersedes", True, "referenced"),
    Marker("per_incuriam", r"\bper\s+incuriam\b", "supersedes", True, "referenced"),
    Marker("distinguished", r"\b(?:is|are)\s+distinguishable\b|\bwe\s+distinguish\b|\bturned\s+on\s+its\s+own\s+facts\b", "exception_of", False, "referenced"),
    Marker("affirmed", r"\b(?:affirmed|upheld)\s+(?:in|by)\b", "supports", False, "referenced"),
    Marker("notwithstanding_clause", r"notwithstanding\s+(?:the\s+foregoing|anything\s+to\s+the\s+contrary)", "supersedes"),
    Marker("except_that", r"\bexcept\s+(?:that|as\s+set\s+forth|to\s+the\s+extent)\b", "exception_of"),
    Marker("provided_however", r"provided,?\s+however,?\s+that", "exception_of"),
    Marker("survival", r"shall\s+survive\s+(?:any\s+)?(?:termination|expiry|expiration)", "conditioned_on"),
    Marker("liability_cap", r"(?:aggregate\s+liability|in\s+no\s+event\s+shall)[^.]{0,200}?(?:exceed|be\s+liable)", "conditioned_on"),
)

SECTION_REF = r"\b(?:sections?|secs?|ss)\s*\.?\s*(\d{1,4}[A-Z]{0,2}(?:\s*(?:,|and|&|or)\s*\d{1,4}[A-Z]{0,2})*)"
SUBSECTION_REF = r"\bsub-?\s*sections?\s*((?:\(\s*\d{1,3}[A-Za-z]?\s*\)\s*(?:,\s*|(?:,\s*)?(?:and|or|&|to)\s*)?)+)(?:\s*of\s+section\s*\.?\s*(\d{1,4}[A-Z]{0,2}))?"
FOREIGN_REF = r"\A\s*of\s+(?:the\s+)?(?:said|principal|repealed|[A-Z][\w'’-]*)(?:[\s,][\w'’.,()\[\]-]+){0,10}?\s*(?:Act|Code|Ordinance|Constitution|Regulations?|Rules)\b"
BREAK = r"[,;:.]"

#: kind, pattern with the surface as its group; the first that fits counts
DEFINITIONS = (
    ("means", r'["«]([^"»]{2,80})["»]\s+means\b'),
    ("includes", r'["«]([^"»]{2,80})["»]\s+includes\b'),
    (None, r'["«]([^"»]{2,80})["»]\s+shall\s+(?:mean|have\s+the\s+meaning)'),
    (None, r'\(\s*(?:herein(?:after)?\s+(?:referred\s+to\s+as|called)|the)\s*["«]([^"»]{2,80})["»]\s*\)'),
    ("means", r'(?m)^\s*\([a-z]\)\s+["“]([^"”]{2,80})["”]\s+means'),
)

#: pattern, ignore case
CITATIONS = (
    (r"\(?\b(19|20)\d{2}\)?\s*\(?\d{0,2}\)?\s*SCC\s+\d+", True),
    (r"\bAIR\s+(?:19|20)\d{2}\s+SC\s+\d+", True),
    (r"\b(19|20)\d{2}\s+INSC\s+\d+", True),
    (r"\b(19|20)\d{2}\s+SCC\s+OnLine\s+\w+\s+\d+", True),
    (r"\bSCR\s+\d+|\bCriLJ\s+\d+|\bITR\s+\d+", True),
    (r"\b(?:[Ss]ection|[Ss]ec\.?|§)\s*(\d+[A-Z]{0,2})(?:\s*\(\s*\d+\s*\))?(?:\s*\(\s*[a-z]{1,2}\s*\))?", False),
    (r"\b[Aa]rticle\s+(\d+[A-Z]{0,2})\b", False),
    (r"\b(?:the\s+)?([A-Z][A-Za-z\s,]{4,60})\s+Act,?\s+((?:19|20)\d{2})\b", False),
    (r"\b[Rr]ule\s+(\d+[A-Z]?)\b", False),
    (r"\b[Oo]rder\s+([IVXL]+),?\s+[Rr]ule\s+(\d+)\b", False),
    (r"\b[Cc]lause\s+(\d+(?:\.\d+)*)\b", False),
    (r"\b(?:Schedule|Annexure|Exhibit|Appendix)\s+([A-Z0-9]{1,3})\b", False),
)

GATE_TERMS = (
    "provided", "notwithstanding", "subject to", "except", "unless",
    "shall not apply", "deemed", "save as", "nothing in", "repeal",
    "substituted", "inserted", "omitted", "overruled", "distinguish",
    "survive", "in no event", "for the purposes of", "means", "includes",
)

#: scope, pattern at the start of what follows an overriding marker, ignore case; the first that fits counts
SCOPES = (
    ("external", r"\s*any\s+other\s+(?:law|enactment|Act)\b", True),
    ("external", r"\s*(?:the\s+)?[A-Z][A-Za-z\s,()]{4,60}\s+Act,?\s+(?:19|20)\d{2}\b", False),
    ("section", r"\s*(?:the\s+provisions\s+of\s+)?(?:sub-)?section\s+\d+[A-Za-z]*", True),
    ("document", r"\s*(?:the\s+(?:other\s+)?provisions\s+of\s+)?this\s+(?:Act|Chapter|Part|Agreement)\b", True),
)

# End of the fixed values.


def starts(text: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    """Does text start with a match?"""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(java(rf"\A(?:{pattern})", ignore_case))
