"""Regular expressions and word lists, in the syntax of java.util.regex.

Fixed values: the patterns, lists and thresholds of this module decide what
counts as a finding, so they are kept as plain text.

Four conventions apply to all patterns here:

* Word boundaries are ASCII only, spelled as look-arounds, because the Java
  ``\\b`` follows Unicode while ``\\w`` does not.
* They run on ``text.searchable`` copies, where every Unicode blank is a vertical
  tab and every Unicode line separator a carriage return. ``BLANK`` is the body
  of a character class with all blanks of such a copy.
* A ``*_GATE`` is a cheap necessary condition for the pattern of the same name.
* Line ends are spelled as look-arounds, so one pass over a whole text gives the
  matches a line-by-line pass would give.
"""

CATEGORIES = ("keys", "privateKeys", "passwords", "email", "ip", "card", "iban", "phone")

BLANK = r" \t\n\x0b\f\r"
# the same without the line feed: patterns built on it never leave their line
LINE_BLANK = r" \t\x0b\f\r"
DOT = r"[^\n\r]"
LINE_END = r"(?![^\n])"
LINE_START = r"(?<![^\n])"
WORD_START = r"(?<!\w)"
WORD_END = r"(?!\w)"
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
# listed one by one, a class is a single table look-up for the regex engine
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ALPHANUMERIC = LETTERS + "0123456789"

# Characters replaced in a searchable copy, and their stand-ins. The two private-use
# characters are the marks that ``text.find_all`` writes.
UNICODE_BLANKS = "\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000\ufeff"
LINE_SEPARATORS = "\u2028\u2029"
MARK, FIELD = "\uf8f0", "\uf8f1"
REPLACED = UNICODE_BLANKS + LINE_SEPARATORS + MARK + FIELD
STAND_INS = "\x0b" * len(UNICODE_BLANKS) + "\r" * len(LINE_SEPARATORS) + "\uf8f2\uf8f3"

# ---- placeholders ----
PLACEHOLDER = WORD_START + r"[A-Z0-9][A-Z0-9_]*_[0-9]+" + WORD_END
IS_PLACEHOLDER = r"\A[A-Z0-9][A-Z0-9_]*_[0-9]+\z"

# ---- personal data ----
_LABEL = rf"[{ALPHANUMERIC}](?:[{ALPHANUMERIC}-]{{0,61}}[{ALPHANUMERIC}])?"
_TOP_LABEL = r"\.[A-Za-z]{2,24}+" + WORD_END
# An address ends with the last label that can be a top-level one. Each round of the outer loop goes on to the next
# such label: the rest of a label that the round before has cut at a hyphen, then whole labels, then the end.
# Possessive loops need no stack, so a domain may have any number of labels.
EMAIL = (
    BOUNDARY + rf"[{ALPHANUMERIC}._%+-]+@" + _LABEL + r"(?=\.)"
    rf"(?:(?:-[{ALPHANUMERIC}-]*+(?<=[{ALPHANUMERIC}])(?<=\.[{ALPHANUMERIC}-]{{2,63}}))?+"
    r"(?:(?!" + _TOP_LABEL + r")\." + _LABEL + r"(?=\.))*+" + _TOP_LABEL + r")++"
)
EMAIL_FILE_ENDING = r"(?i)\.(?:png|jpe?g|gif|svg|webp|avif|ico|js|mjs|css|map|json|txt|log)\z"
EMAIL_INSIDE_URL = r"://[^" + BLANK + r"/@]{0,197}\z"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = r"(?<![\w.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\w|\.\d)"
IPV4_GATE = r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"
IPV4_NO_INFORMATION = r"\A(?:127\.|0\.0\.0\.0\z|255\.255\.255\.255\z)"
IPV4_IS_VERSION = r"(?i)version\W{0,3}\z"

IPV6_GATE = r":[0-9A-Fa-f]{0,4}:"
IPV6 = r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)"

CARD = (
    r"(?<![\d-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})??|\d{4}([ -]?)\d{6}\2\d{4,5}|\d{13,19})(?![\d-])"
)
CARD_GATE = r"[0-9](?:[ -]?[0-9]){12}"
CARD_ISSUER = r"\A(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6)"

IBAN = WORD_START + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + WORD_END
IBAN_GATE = r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]"

PHONE = (
    r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){2,4}"
    r"|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-]|\.\d)"
)
PHONE_GATE = r"\+[0-9]|\([0-9]{3}\)|[0-9]-[0-9]{3}-[0-9]{4}"

# ---- credentials in headers and addresses ----
# groups: 1 everything before the token, 2 and 3 the scheme word, 4 the token
AUTH_HEADER = (
    r"(?=[AaBb])(?i)(" + WORD_START + r"(?:authorization[ \t]*[\"']?[ \t]*[:=][ \t]*[\"']?(bearer|basic|token)[ \t]+"
    r"|(bearer)[ \t]+))([A-Za-z0-9\-._~+/]{12,}=*)"
)
AUTH_GATE = r"(?=[AaBb])(?i:bearer|authorization)"
# groups: 1 everything before the password, 2 the scheme, 3 the password
URL_LOGIN = (
    r"(?i)(" + WORD_START + r"([a-z][a-z0-9+.-]{1,20}+)://[^" + BLANK + r":@/?#'\"]+:)"
    r"([^" + BLANK + r"/?#'\"]+)@"
)
DATABASE_SCHEME = (
    r"(?i)\A(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|rediss?|amqps?|mssql|sqlserver"
    r"|oracle|cockroachdb|clickhouse|couchdb|neo4j(?:\+s)?)\z"
)

# ---- assignments ----
_BREAK = r"\n\r"
_NAME = r"[A-Za-z_][\w.-]*+"
_TAIL = r"[ \t]*,?[ \t]*\r?(?![^" + _BREAK + r"])"
_HEAD = r"(?<![^" + _BREAK + r"])[ \t]*(?:export[ \t]+)?"
# A whole-line assignment matches only up to its value (the value sits in the
# look-ahead, group 1), so pairs inside the value are found by the same pass.
# A JSON member and an inline pair match as a whole.
# All three begin behind something that is no part of a name: one look, taken first.
ASSIGNMENT = (
    r"(?<![\w.-])(?:" + _HEAD + _NAME + r"[ \t]*[:=][ \t]*(?:[\"']?+"
    r"(?=((?<=\")[^\"\n]+(?=\"" + _TAIL + r")|(?<=')[^'\n]+(?='" + _TAIL + r")"
    r"|(?<![\"'])[^" + BLANK + r"\"'][^" + BLANK + r"]*?(?=" + _TAIL + r")))"
    r"|(?:\"\"|'')" + _TAIL + r")"
    r"|\"" + _NAME + r"\"[ \t]*:[ \t]*\"(?:[^\"\\\n]|\\" + DOT + r")*+\""
    rf"|[{LETTERS}_][\w.-]*+[ \t]*=[ \t]*"
    r"(?:\"[^\"\n]*\"|'[^'\n]*'|[^" + BLANK + r"\"'<>,;&()]+))"
)
# the parts of a match: key of a line or pair, key and value of a member, value of a pair
ASSIGNED_KEY = r"\A[ \t]*(?:export[ \t]+)?(" + _NAME + r")[ \t]*[:=]"
MEMBER = r"(?s)\A\"([^\"]*)\"[ \t]*:[ \t]*\"(.*)\"\z"
# groups: 1 the quote, 2 a quoted value, 3 a bare value
PAIR_VALUE = r"(?s)\A[\w.-]+[ \t]*=[ \t]*(?:([\"'])(.*)\1|([^\"']*))\z"
# no named secret and no high-entropy value without one of these
ASSIGNMENT_GATE = (
    r"(?=[CKPSTckpst])(?i:p(?:ass|wd|rivate)|secret|token|credential|key)[\w.-]*+\"?[ \t]*+[:=]"
    r"|[:=][ \t]*+[\"']?[\w+/=.~-]{20}"
)
NOT_A_VALUE = (
    r"(?i)\A(?:\*+|x+|\.\.\.|<[^>]*>|\[[^\]]*\]|\$\{?[\w.]+\}?|%\w+%|\{\{" + DOT + r"*\}\}"
    r"|null|nil|none|undefined|true|false|yes|no|on|off|changeme|redacted|[A-Z0-9][A-Z0-9_]*_\d+)\z"
)
DOTTED_NAME = r"\A[A-Za-z_$][\w$-]*(?:\.[A-Za-z_$][\w$-]*)++\z"
CALL_OR_INDEX = r"\A[A-Za-z_$][\w$.]*[\[(]"
SECRET_NAME = r"PASSWORD|PASSWD|PASSPHRASE|SECRET|TOKEN|PRIVATE|CREDENTIAL"
PUBLIC_NAME = r"PUBLIC|PUBLISHABLE"
NAME_SEGMENTS = r"[_.-]|(?<=[a-z0-9])(?=[A-Z])"
SECRET_SEGMENT = r"\A(?:[A-Z]*KEYS?|PASS|PWD)\z"
# no segment of a name in capitals fits without one of these
SECRET_SEGMENT_GATE = r"KEY|PASS|PWD"
IDENTIFIER_NAME = (
    r"(?:^|[_.-])(?i:ids?|uuid|guid|hash|sha\d*|md5|commit|rev|revision|checksum|digest|etag|integrity|nonce"
    r"|trace|span|request|build|version|path|file|filename|dir|url|uri|href|src|name|image|class|type)\z"
    r"|(?i:[a-z](?:Id|Hash|Url|Path|Name))\z"
)
OPAQUE_VALUE = r"\A[\w+/=.~-]+\z"
HEX_ONLY = r"(?i)\A[0-9a-f-]+\z"

# ---- values every rule and assignment ignores ----
GLOBAL_ALLOW = (
    r"(?i)\Atrue|false|null\z",
    r"(?i)\A(?:a+|b+|c+|d+|e+|f+|g+|h+|i+|j+|k+|l+|m+|n+|o+|p+|q+|r+|s+|t+|u+|v+|w+|x+|y+|z+|\*+|\.+)\z",
    r"\A\$(?:\d+|\{\d+\})\z",
    r"\A\$(?:[A-Z_]+|[a-z_]+)\z",
    r"\A\$\{(?:[A-Z_]+|[a-z_]+)\}\z",
    r"\A\{\{[ \t]*[\w ().|]+[ \t]*\}\}\z",
    r"\A\$\{\{[ \t]*(?:(?:env|github|secrets|vars)(?:\.[A-Za-z]\w+)+[\w \"'&./=|]*)[ \t]*\}\}\z",
    r"\A%(?:[A-Z_]+|[a-z_]+)%\z",
    r"\A%[+\-# 0]?[bcdeEfFgGoOpqstTUvxX]\z",
    r"\A\{\d{0,2}\}\z",
    r"\A@(?:[A-Z_]+|[a-z_]+)@\z",
    r"(?i)\A/Users/[a-z0-9]+/[\w .-/]+\z",
    r"\A/(?:bin|etc|home|opt|tmp|usr|var)/[\w ./-]+\z",
)
GLOBAL_STOPWORDS = ("014df517-39d1-4453-b7b3-9930c563627c", "abcdefghijklmnopqrstuvwxyz")
# no value is allowed by a pattern above without the first gate, none holds a stop word without the second one; the
# letters of the second have no other letter that becomes one of them in lower case
GLOBAL_ALLOW_GATE = r"(?i)\A(?:[$%*./@{]|true|([a-z])\1*+\z)|(?=[fn])(?:false|null\z)"
GLOBAL_STOPWORD_GATE = r"(?i)014df517|lmnopqrstuv"
