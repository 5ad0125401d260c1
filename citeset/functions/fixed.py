"""Word lists and patterns that decide which queries are kept."""

# Fixed values. Phrases that open a sentence depending on the one before it.
ANAPHORIC_STARTS = (
    "this", "that", "these", "those", "it", "its", "they", "them", "their", "he", "him", "his", "she", "her", "hers",
    "the same", "the former", "the latter", "former", "latter", "other", "another", "such", "similar", "both", "each", "either", "neither",
)
# Fixed values. Discourse connectives that are stripped from the beginning of a query.
CONNECTIVES = (
    "therefore", "thus", "hence", "consequently", "accordingly", "as a result", "however", "nevertheless", "nonetheless", "still",
    "instead", "moreover", "furthermore", "further", "in addition", "additionally", "also", "for example", "for instance", "likewise",
    "similarly", "in contrast", "by contrast", "conversely", "specifically", "notably", "indeed", "meanwhile", "recently", "overall",
    "in summary", "in conclusion", "importantly", "interestingly", "surprisingly", "unfortunately", "it has been found that",
    "it was found that", "it is noteworthy that", "it should be noted that",
)
# Fixed values. Openings that point at the cited work itself.
REFERENCE_FRAMING_STARTS = (
    "according to", "as shown in", "as described in", "as reported in", "as mentioned in", "as stated in", "as summarized in",
    "as detailed in", "as outlined in", "as illustrated in", "as demonstrated in", "as evidenced by", "as revealed by",
    "as indicated by", "as documented in", "as highlighted in", "as emphasized in",
)
# Fixed values. Openings that point at another place of the same article.
LOCAL_CONTEXT_STARTS = ("figure", "fig.", "table", "section", "appendix", "supplementary figure", "supplementary fig.", "supplementary table", "see")
# Fixed values. Openings of summarising sentences.
SUMMARY_STARTS = (
    "taken together", "in summary", "overall", "in conclusion", "in brief", "in short", "to sum up", "to summarize", "in essence",
    "in a nutshell", "in a word", "all in all", "on the whole", "in general", "generally speaking",
)
# Fixed values. Words after which a period does not end a sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "dr.", "prof.", "ph.d.", "fig.", "u.s.", "vs.")
# Fixed values. Elements whose captions are text, and elements that are skipped with all they hold.
CAPTION_TAGS = frozenset({"fig", "table-wrap"})
SKIPPED_TAGS = frozenset({"alternatives", "chem-struct-wrap", "disp-formula", "graphic", "math", "media", "supplementary-material", "tex-math"})

_NAME = r"\b[A-ZÀ-ÖØ-Þ][\wÀ-ÖØ-öø-ÿ'’‐‑–-]+(?:\s+(?:et\s+al\.|and|&)\s*[A-ZÀ-ÖØ-Þ][\wÀ-ÖØ-öø-ÿ'’‐‑–-]+)?"
_YEAR = r"(?:18|19|20)\d{2}[a-z]?"
# Fixed values. Java patterns by reason, in the order in which reasons are reported.
RESIDUAL_PATTERNS = {
    "parenthetical_author_year": rf"(?iU)\((?=[^()\n]{{0,240}}\b{_YEAR}\b)(?=[^()\n]{{0,240}}(?:[,;&]|\band\b|\bet\s+al\.))[^()\n]{{1,240}}\)",
    "narrative_author_year": rf"(?U){_NAME}\s*\(\s*{_YEAR}\s*\)",
    "unwrapped_author_year": rf"(?U){_NAME}\s*,\s*{_YEAR}\b",
    "et_al": r"(?iU)\bet al\.",
    "numeric_citation": r"(?iU)\[\s*\d{1,4}(?:[a-z])?(?:\s*(?:[,;/]|[-–—−]|\band\b)\s*\d{1,4}(?:[a-z])?)*\s*\]",
    "bibliographic_identifier": r"(?iU)\b(?:doi|pmid|pmcid)\s*:\s*(?:10\.)?[a-z0-9./_-]+",
    "nonpublic_citation": r"(?iU)\b(?:unpublished\s+data|personal\s+communication|in\s+press)\b",
    "empty_citation_placeholder": r"(?iU)\(\s*(?:e\.g\.|i\.e\.)\s*,?\s*\)",
    "publisher_artifact": "▸",
    "internal_xref_marker": r"(?iU)\[xref:[^\]\s]+\]",
}
# Fixed value. References to other places of the article, anywhere in a query.
LOCAL_REFERENCE = (
    r"(?iU)\b(?:figure|fig\.|table|section|appendix|supplementary\s+(?:figure|fig\.|table))\s+[a-z0-9ivx.-]+\b"
    r"|\b(?:as\s+(?:described|discussed|mentioned|reported|shown)|see)\s+(?:above|below)\b"
)
# Fixed values. Markers of citations in normalised text, and runs of them.
MARKER = r"\[xref:[^\]\s]+\]"
MARKER_RUN = rf"{MARKER}(?:\s*(?:(?:[,;/&–—−-]|\band\b|\bto\b)\s*)?{MARKER})*"
# Fixed values. Names of citation forms, diagnostics, statuses.
FORMS = ("label_only", "parenthetical_author_year", "narrative_author_year", "malformed")
DIAGNOSTICS = ("missing_rid", "unknown_rid", "ambiguous_label", "invalid_range")
# Fixed values. Upper bounds of the histogram's right-closed bins, and their labels.
BINS = ((0, "0"), (9, "1-9"), (19, "10-19"), (24, "20-24"), (49, "25-49"), (99, "50-99"), (199, "100-199"), (None, "200+"))
