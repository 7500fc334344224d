"""Patterns, code points and names that results depend on."""

# --- fixed values: special tokens, in id order -------------------------------
SPECIAL_TOKENS = ("[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]")

# --- fixed values: private-use layout ----------------------------------------
PARAM_BASE = 0xE000          # parameter n is the code point U+E000 + n
PARAM_MAX = 255              # largest position or count an operator can carry
CAPITALIZE = 0xE100
REPEAT = 0xE200
MULTIREPEAT = 0xE201

# --- fixed values: combining mark -> (name, opcode) --------------------------
MARK_OPS = {
    "\u0303": ("TILDE", 0xE101),
    "\u0301": ("ACUTE", 0xE102),
    "\u0300": ("GRAVE", 0xE103),
    "\u0302": ("CIRCUMFLEX", 0xE104),
    "\u0308": ("DIAERESIS", 0xE105),
    "\u0304": ("MACRON", 0xE106),
    "\u0307": ("DOT_ABOVE", 0xE107),
    "\u030A": ("RING_ABOVE", 0xE108),
    "\u030B": ("DOUBLE_ACUTE", 0xE109),
    "\u030C": ("CARON", 0xE10A),
    "\u0326": ("COMMA_BELOW", 0xE10B),
    "\u0327": ("CEDILLA", 0xE10C),
    "\u0328": ("OGONEK", 0xE10D),
}
OP_NAMES = {
    CAPITALIZE: "CAPITALIZE",
    **{code: name for name, code in MARK_OPS.values()},
    REPEAT: "REPEAT",
    MULTIREPEAT: "MULTIREPEAT",
}

MARK_CLASS = "".join(MARK_OPS)
METASPACE = "▁"

# Two private-use ranges are in use on purpose: vocabulary entries are cleaned
# with the narrow one, generated text with the wide one.
PUA_VOCAB = r"\uE000-\uF0FF"
PUA_WIDE = r"\uE000-\uF8FF"

# --- fixed values: pre-tokenizer patterns, in Java syntax --------------------
# Matches and the gaps between matches are both pieces; the last alternative
# spells out the gap. Character classes carry the loops, so the regex engine
# iterates instead of recursing and a megabyte-long word cannot overflow a stack.
SPLIT_PIECE = r"(?U)\n+|\t+|[ ]|[^\p{L}\p{N}\s _]+|[\p{L}\p{N}_\s&&[^\n\t ]]+"
LLAMA_PIECE = (
    r"(?U)(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)
METASPACE_PIECE = f"{METASPACE}?[^{METASPACE}]+|{METASPACE}"
WHITESPACE_PIECE = r"(?U)\w+|[^\w\s]+"
PUNCTUATION_RUN = r"(?U)[^\w\s]{2,}"

CLUSTER = f"(?s).[{MARK_CLASS}]*"
OP_TOKEN = r"[\uE100-\uEFFF][\uE000-\uE0FF]+"
_PARAM = r"[\uE000-\uE0FF]"
#: An operator with as many parameters as it takes.
WHOLE_OP = rf"[\uE100-\uE1FF]{_PARAM}|\uE200{_PARAM}{{2}}|\uE201{_PARAM}{{3}}"
ENCODED_UNIT = r"(?s)[\uE100-\uEFFF][\uE000-\uEFFF]*[^\uE100-\uEFFF]*|[^\uE100-\uEFFF]+"

# Code points whose NFC form is themselves wherever they stand: Latin letters,
# general punctuation and currency signs. Text made of these alone skips the
# normalisation UDF.
NFC_INERT = r"\x00-\u02FF\u2010-\u2027\u2030-\u205E\u20A0-\u20BF"
