"""Regular expressions and fixed values shared by the Spark expressions and
their DuckDB twins.

Spark runs Java regexes, DuckDB runs RE2.  Both accept ``\\x{...}`` code
points and ``\\p{..}`` classes, so every class is spelled out explicitly
(``\\w`` and ``\\s`` are ASCII-only in one engine and Unicode in the other).
Java's ``.`` also stops at ``\\r``/``\\u2028``; the ``(?d)`` flag restricts
line terminators to ``\\n``, which is what RE2 and Python do.
"""

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for equal results)
# ---------------------------------------------------------------------------

# Emoji class: the listed ranges 24C2-1F251 and 10000-10FFFF swallow every
# other listed range, so the class reduces to these five items.
EMOJI_CLASS = r"[\x{200D}\x{231A}\x{23CF}\x{23E9}\x{24C2}-\x{10FFFF}]"
# The same class for Java, which tests most characters against the first range only.
EMOJI_JAVA = r"[[\x{200D}-\x{10FFFF}]&&" + EMOJI_CLASS + "]"

# Link tags are removed together with their text; other tags keep the text.
A_TAG = r'<a href=".*?">.*?</a>'

# Sentence-piece separator, exclamation runs, question runs.
SENT_SEP = r"[.!?]+"
EXCLAMATION = r"!+"
QUESTION = r"\?+"

# Flesch reading-ease bands: half-open [lo, hi) with their labels.
FLESCH_BANDS = [
    (0, 30, "very confusing"),
    (30, 50, "difficult"),
    (50, 60, "fairly difficult"),
    (60, 70, "standard"),
    (70, 80, "fairly easy"),
    (80, 90, "easy"),
    (90, 101, "very easy"),
]
FLESCH_OTHER = "unclassified"

# Target categories of the lexicon ratios, in output order.
LEXICON_TARGETS = ["Affect", "I", "Other", "We", "You"]

# ---------------------------------------------------------------------------
# Derived character classes (not reference values; engine-neutral spelling)
# ---------------------------------------------------------------------------

# Unicode "word" character (letters, marks, decimal digits, connectors).
WORD_CHAR = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
WORD = WORD_CHAR + "+"

# Unicode white space as Python's str.isspace() sees it.
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_RUN = WS_CLASS + "+"
# White-space runs but for single blanks, which are what a run becomes.
WS_NO_BLANK = ("(?:" + WS_CLASS.replace(r"\x1C-\x20", r"\x1C-\x1F") + "| (?=" + WS_CLASS + "))" + WS_CLASS + "*")
EDGE_WS = "^" + WS_RUN + "|" + WS_RUN + "$"

# Plain tags <w> and </w>.
PLAIN_TAG = "</?" + WORD_CHAR + "+>"

# Vowel groups used as syllables for the German Flesch formula (re-aimed).
SYLLABLE = r"[aeiouyäöüàâáéèêëíìîïóòôúùû]+"
SYLLABLE_END = SYLLABLE[:-1] + "(?!" + SYLLABLE[:-1] + ")"

# Whitespace token separator for the lexicon engine (awk FS=" " semantics:
# runs of blanks, tabs and newlines).
TOKEN_SEP = r"[ \t\n]+"


def java(pattern: str) -> str:
    """Spark (java.util.regex) spelling: newline-only line terminators."""
    return "(?d)" + pattern


def re2(pattern: str) -> str:
    """DuckDB (RE2) spelling."""
    return pattern

# ---------------------------------------------------------------------------
# Category id -> name of the German category dictionary
# (ids 1..68 in order).
# ---------------------------------------------------------------------------
CATEGORY_NAMES = [
    "Pronoun", "I", "We", "Self", "You", "Other", "Negate", "Assent", "Article", "Preps",
    "Number", "Affect", "Posemo", "Posfeel", "Optim", "Negemo", "Anx", "Anger", "Sad", "Cogmech",
    "Cause", "Insight", "Discrep", "Inhib", "Tentat", "Certain", "Senses", "See", "Hear", "Feel",
    "Social", "Comm", "Othref", "Friends", "Family", "Humans", "Time", "Past", "Present", "Future",
    "Space", "Up", "Down", "Incl", "Excl", "Motion", "Occup", "School", "Job", "Achieve",
    "Leisure", "Home", "Sports", "TV", "Music", "Money", "Metaph", "Relig", "Death", "Physcal",
    "Body", "Sexual", "Eating", "Sleep", "Groom", "Swear", "Nonfl", "Fillers",
]
