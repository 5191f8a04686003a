"""Text functions as column expressions. All run inside the JVM; nulls give null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for retrieval.
STOPWORDS = (
    "the a an and or of to in on for with that this is are was were be been as at by it its from has have had not no but which who whom whose will would shall should may might can could"
    " i he she they we you my his her their our your me him them us do does did so if then than"
).split()

# Markers of document kinds, in lower case.
PLEADING_MARKERS = ("particulars of claim", "statement of case", "defence and counterclaim", "re-amended defence", "amended defence", "the defence", "counterclaim", "reply to defence", "rejoinder", "generic particulars")
WITNESS_MARKERS = ("witness statement of", "will say as follows", "i believe that the facts")
EXHIBIT_MARKERS = ("exhibit", "this is the exhibit marked", "annexed hereto")

# Legal concepts that are looked for in pleadings.
CONCEPTS = (
    "misrepresentation", "breach of contract", "unfair contract terms", "consumer protection", "accounting", "software", "electronic evidence", "burden of proof",
    "negligence", "duty of care", "data protection", "liability", "good faith", "disclosure", "damages", "limitation",
)

# Words of a chat message that are not searched for.
CHAT_STOPWORDS = "what which where this that case tell show find about have with from they there help does could would your their been into than then them".split()

# Patterns (Java) of paragraph labels, denials, sentence ends and page furniture.
LABEL = r"(?i)^\s*(\d+\.|\(?[a-z]\)|[a-z]\.|\(?(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\))"
DENIAL = r"(?i)\b(denie[sd]|deny|denying|not admitted|no admission|is denied|are denied|disput\w+|reject\w+|refut\w+)\b"
SENTENCE_END = r"(?<=[.;])\s+(?=[\"'(A-Z])"
PARAGRAPH_START = r"(?i)^\s*(\d+\.|\(?[a-z]\)|[a-z]\.|\(?(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\)|Question\b|Answer\b)"
PAGE_FOOTER = r"(?i)^\s*Page\s+\d+\s+of\s+\d+\s*$"
ENVELOPE_LINE = r"(?i)^\s*DocuSign Envelope ID:.*$"
PIPE_FOR_I = r"(^|[\s(])\|(?=[\s,.;:)])"

# Views a chat message can ask for, with their words, in order, and the phrases that ask.
NAVIGATION_PHRASES = ("go to", "open", "show me", "show the", "take me", "switch to", "navigate", "bring up", "jump to")
NAVIGATION_VIEWS = (
    ("damages", ("financial", "damages", "quantum", "money", "loss", "compensation")),
    ("graph", ("graph", "network", "connections", "map of")),
    ("argumentation", ("argument", "argumentation", "case theory")),
    ("builder", ("builder", "build the case", "build my case", "assemble")),
    ("propositions", ("proposition", "proof matrix", "matrix", "allegation", "claims")),
    ("home", ("home", "landing", "start screen", "main screen")),
)

#: Pieces shorter than this stay with the sentence before them; spans shorter than the second are dropped.
SHORT_PIECE, SHORT_SPAN = 20, 40


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def any_contains(c: Column, needles: tuple[str, ...] | list[str]) -> Column:
    """Whether any of ``needles`` occurs."""
    out = F.contains(c, F.lit(needles[0]))
    for n in needles[1:]:
        out = out | F.contains(c, F.lit(n))
    return out


def count_contained(c: Column, needles: tuple[str, ...]) -> Column:
    """How many of ``needles`` occur."""
    out = F.lit(0)
    for n in needles:
        out = out + F.contains(c, F.lit(n)).cast("int")
    return out


def fix_glyphs(c: Column) -> Column:
    """Glyphs that fonts fail to map, and a lone pipe that stands for I."""
    return F.regexp_replace(F.translate(c, "\ufffd\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "'''\"\"-- "), PIPE_FOR_I, "$1I")


def quote_form(c: Column) -> Column:
    """The form in which quotes are compared: lower case, no quotation marks, single blanks; null as empty."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[\"'`\u2018\u2019\u201c\u201d]", ""))


def quote_found(quote: Column, source: Column) -> Column:
    """Whether a quote of at least eight characters stands in the source, both in quote form."""
    return (F.length(quote) >= 8) & F.contains(source, quote)


def tokens(c: Column) -> Column:
    """Search tokens with repetitions; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def label_of(c: Column) -> Column:
    """The leading paragraph label, or an empty text."""
    return F.regexp_extract(c, LABEL, 1)


def sentences(c: Column) -> Column:
    """Sentences; short pieces stay with the one before."""
    pieces = F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")
    join = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), s)))
    return F.aggregate(pieces, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.length(s) < SHORT_PIECE), join(acc, s)).otherwise(F.concat(acc, F.array(s))))


def unlabelled(text: Column, label: Column) -> Column:
    """A paragraph without the label it repeats."""
    return F.when((F.coalesce(label, F.lit("")) != "") & F.startswith(text, label), strip(F.substring(text, F.length(label) + 1, F.length(text)))).otherwise(text)


def spans(text: Column, label: Column) -> Column:
    """Sentences of substance of a paragraph."""
    bare = unlabelled(text, label)
    return F.when(F.length(bare) >= SHORT_SPAN, F.filter(sentences(bare), lambda s: F.length(s) >= SHORT_SPAN)).otherwise(F.array().cast("array<string>"))


def document_kind(opening: Column, title: Column) -> Column:
    """The kind of a document from the markers in its opening (text and metadata) or title, in lower case."""
    hit = lambda markers: sum((F.contains(opening, F.lit(m)) | F.contains(title, F.lit(m))).cast("int") for m in markers)
    pleading, witness, exhibit = hit(PLEADING_MARKERS), hit(WITNESS_MARKERS), hit(EXHIBIT_MARKERS)
    return F.when((witness > 0) & (witness >= pleading), "witness_statement").when(pleading > 0, "pleading").when((exhibit > 0) & (witness == 0), "exhibit").otherwise("other")


def party_of(named: Column) -> Column:
    """The party a document's title and id point to; the defendant's words come first."""
    low = F.lower(named)
    return F.when(any_contains(low, ("defence", "defendant", "counterclaim")), "Defendant").when(any_contains(low, ("claim", "claimant", "particulars")), "Claimant").otherwise("")


def is_denial(c: Column) -> Column:
    """Whether a sentence denies."""
    return c.rlike(DENIAL)


def citation_key(c: Column) -> Column:
    """One key for the ways to write a citation: paragraph numbers as ``para:n``, other ids without blanks.
    Compatibility characters are folded for the full-width block, which is all that ids hold."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "\u3000\u00a0"
    low = strip(F.lower(F.translate(c, wide, "".join(chr(0x21 + i) for i in range(94)) + "  ")))
    low = F.replace(F.replace(F.replace(low, F.lit("\u00b6"), F.lit("para ")), F.lit("paragraph"), F.lit("para")), F.lit("\u00a7"), F.lit("para "))
    number = F.regexp_extract(low, r"^(?:para(?U:\s)*)?0*([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("para:"), number)).otherwise(F.regexp_replace(low, r"(?U)\s+", ""))


def citation_label(doc: Column, paragraph: Column) -> Column:
    """``doc ¶paragraph``, or whichever is present."""
    blank = lambda x: F.when(strip(x) == "", F.lit(None)).otherwise(strip(x))
    return F.concat_ws(" \u00b6", blank(doc), blank(paragraph))


def concepts(c: Column) -> Column:
    """Legal concepts that occur, in their fixed order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.lit(x) for x in CONCEPTS]), lambda x: F.contains(low, x))


def padded_concepts(found: Column, limit: int = 6) -> Column:
    """At least two search terms, at most ``limit``."""
    padded = F.array_union(found, F.array(F.lit("contract"), F.lit("evidence")))
    return F.slice(F.when(F.size(found) < 2, padded).otherwise(found), 1, limit)


def ellipsis(c: Column, n: int = 90) -> Column:
    """At most ``n`` characters, the last an ellipsis if cut."""
    flat = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("\u2026"))).otherwise(flat)


def question_form(c: Column) -> Column:
    """The form under which questions are cached."""
    return F.regexp_replace(squeeze(F.lower(F.coalesce(c, F.lit("")))), r"[ ?.!]+$", "")


def cache_key(signature: Column, question: Column) -> Column:
    """The first sixteen hex digits that name a cached answer."""
    return F.substring(F.sha2(F.concat_ws("|", signature, question_form(question)), 256), 1, 16)


def chunks(c: Column) -> Column:
    """Words with the white space behind them; joined they give the text back."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+\s*"), F.lit(0))


def chat_words(c: Column) -> Column:
    """Different words of a message that are searched for."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z']{4,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in CHAT_STOPWORDS]))


def goal_words(c: Column) -> Column:
    """Words of a goal longer than three characters."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) > 3)


def navigation(c: Column) -> Column:
    """The view a message asks for, or null."""
    low = F.lower(F.coalesce(c, F.lit("")))
    view = F.lit(None).cast("string")
    for name, needles in reversed(NAVIGATION_VIEWS):
        view = F.when(any_contains(low, needles), name).otherwise(view)
    return F.when(any_contains(low, NAVIGATION_PHRASES), view)


def headline(c: Column) -> Column:
    """First line of a narrative after its ``HEADLINE:`` mark."""
    return strip(F.split(strip(_narrative(c)), "\n")[0])


def narrative_paragraphs(c: Column, most: int = 6) -> Column:
    """Paragraphs of a narrative after its headline."""
    blocks = F.filter(F.transform(F.split(_narrative(c), "\n\n"), strip), lambda b: b != "")
    rest = strip(F.array_join(F.slice(F.split(blocks[0], "\n"), 2, 1_000_000), " "))
    every = F.concat(F.array(rest), F.slice(blocks, 2, 1_000_000))
    return F.when(F.size(blocks) == 0, F.array().cast("array<string>")).otherwise(F.slice(F.filter(every, lambda p: p != ""), 1, most))


def _narrative(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)^.*?HEADLINE:", "")


def money(c: Column) -> Column:
    """``£`` with thousands separators and no pence, the sign in front."""
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("\u00a3"), F.format_number(F.abs(c), 0))


def title_from_name(c: Column) -> Column:
    """A title from a file name: no leading number, underscores as blanks."""
    bare = F.translate(F.regexp_replace(c, r"^\d+[_\s-]*", ""), "_", " ")
    return F.when(strip(bare) == "", c).otherwise(strip(bare))
