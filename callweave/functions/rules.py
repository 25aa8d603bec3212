"""Rule tables of the conversation operators: fixed values, as plain data.

The lists below are fixed values: results depend on them word for word. Everything that
names a business is a parameter of the operators instead.
"""

from __future__ import annotations

# Interjections that count as fillers.
FILLERS = ["um", "uh", "umm", "uhh", "hmm", "hmmm", "er", "err", "ah", "ahh"]

# Patterns of a self-introduction.
AGENT_INTRO = [
    r"\bmy name is \w+",
    r"\bthis is \w+\s+(?:from|calling|with)\b",
    r"\bI'?m calling (?:from|on behalf)\b",
    r"\bI'?ll be your\b.+?(?:advisor|expert|agent|consultant|specialist)",
    r"\bcalling from\b",
    r"\bsenior travel\b",
    r"\bdedicated expert\b",
    r"\blet me (?:check|look|pull up|find)\b.+?(?:fares?|options?|flights?|availability)",
]
#: The further introduction pattern of a company; {names} is an alternation of patterns.
AGENT_INTRO_COMPANY = r"\bI'?m (?:\w+\s+)?(?:from|with)\s+(?:{names})\b"

# Patterns of an agent who answers a call.
INBOUND_AGENT = [
    r"\bthank you for (?:calling|holding|contacting)\b",
    r"\byou(?:'re| are) speaking (?:to|with)\b",
    r"\bhow (?:can|may) I (?:help|assist)\b",
    r"\bwhat can I (?:do|help)\b",
    r"\bwelcome to\b.+?(?:travel|support|service|desk|line)",
]

# Patterns of agent behaviour.
AGENT_BEHAVIOUR = [
    r"\bhow (?:can|may) I (?:help|assist)\b",
    r"\bwhat can I (?:do|help)\b",
    r"\byou (?:are|'re) (?:talking|speaking) (?:to|with)\b",
    r"\bhave you ever contacted\b",
    r"\bbefore we proceed\b",
    r"\bmay I (?:have|know|get) your\b",
    r"\bI(?:'ll| will) help you\b",
    r"\blet me (?:check|find|look|pull up|search)\b",
]

# Phrases of automated announcements.
ANNOUNCEMENTS = [
    "this call is being recorded",
    "call may be monitored",
    "call is being recorded",
    "for quality assurance",
    "for quality and training",
    "your call is important",
    "please hold",
]

# Patterns of a client.
CLIENT = [
    r"^(?:hello|hi|hey|yes|yeah)\s*\?\s*$",
    r"\bwho(?:'s| is) (?:this|calling)\b",
    r"\bhow did you get (?:my|this) number\b",
    r"\bI(?:'m| am) (?:looking|interested|trying)\b",
    r"\bI (?:need|want|would like)\s+(?:a |to )?\b(?:fly|flight|ticket|book)",
    r"\bmy budget is\b",
    r"\bwe(?:'re| are) (?:traveling|flying|going)\b",
    r"\bI (?:saw|found|got)\s+(?:your|an?|the)\s+(?:ad|number|email|website)",
]

# Signals of a follow-up in the first 1000 characters.
FOLLOW_UP = [
    "it's me again", "i'm calling you back", "calling you back", "we spoke earlier", "we spoke before",
    "we spoke yesterday", "we spoke last", "we talked earlier", "we talked before", "we talked yesterday",
    "we talked last", "sorry i missed", "returning your call", "following up", "as we discussed",
    "as i mentioned", "i called earlier", "i called before", "i called yesterday", "you called me",
    "you left a message", "per our conversation", "continuing our conversation", "further to our call",
    "i looked into", "i checked the", "i checked a couple", "i found some", "i got the prices",
    "i got some options", "here are the options", "here are the deals", "i was working on",
    "i've been working on", "as promised",
]
FOLLOW_UP_RESULTS = ["follow-up", "followup", "callback"]
FOLLOW_UP_STATUS = ["follow", "callback"]
FOLLOW_UP_FILES = ["2nd", "second", "follow"]

# Words that stand where a name would but are none.
NO_NAMES = [
    "calling", "leaving", "working", "looking", "going", "trying", "speaking", "reaching", "getting", "checking",
    "helping", "here", "there", "just", "also", "actually", "basically", "someone", "anyone", "everyone", "nobody",
    "sure", "glad", "happy", "sorry", "the", "this", "that", "what",
]
# Where an agent says a name.
NAME_INTRO = [r"\bmy name is (\w+)", r"\bthis is (\w+)\s+(?:from|calling|with)\b", r"\bI'?m (\w+)\s+(?:from|calling|with)\b"]

# Hold language before a silence.
HOLD = (
    r"\b(?:hold|on hold|one moment|just a moment|give me a moment|bear with me|"
    r"let me (?:check|look|see|find|pull up|search|verify)|(?:give|need) (?:me )?(?:a )?(?:sec(?:ond)?|minute|moment)|"
    r"hang (?:on|tight)|two seconds?|one second?|un moment(?:o)?|I'?ll be right back)\b"
)

# Tags of masked personal data in evidence.
PII_TAGS = ["[PHONE]", "[EMAIL]", "[SPELLED_PII]", "[NATO_SPELLED]", "[PNR]", "[BOOKING_REF]", "[CC_NUMBER]", "[SSN]"]

# A word spelled out letter by letter.
SPELLED = r"(?:[A-Za-z]\s*(?:,\s*)?(?:as in|for|like)\s+\w+[,.\s]*){4,}"
SPELLED_LOOSE = r"(?:[A-Za-z]\s+[A-Za-z]{2,}(?:\s+as\s+in)?[,.\s]*){4,}"

# Labels that count for either side of the listening ratio.
AGENT_LABELS = ["agent:", "representative:", "rep:", "advisor:"]
CLIENT_LABELS = ["client:", "customer:", "caller:", "guest:"]

# First bytes of audio files, in hex.
MAGIC = {"494433": "mp3", "FFFB": "mp3", "FFF3": "mp3", "FFF2": "mp3", "52494646": "wav", "664C6143": "flac", "4F676753": "ogg"}

# The mark at a cut of a transcript.
CUT_MARK = "\n\n[...transcript truncated due to length...]\n\n"

# Keys that exports and caches leave out or keep.
NOT_EXPORTED = ["raw_response", "raw_text", "raw_llm_output", "system_prompt", "user_prompt"]

# Limits and prices.
MIN_WORDS, MIN_CHARS = 50, 200
MAX_CHARS = 500_000
TOKENS_PER_WORD = 1.8
STT_CREDITS_PER_MINUTE, STT_USD_PER_MINUTE = 280, 0.005
LLM_USD_PER_CALL = 0.003
MAX_FILE_BYTES = 500 * 1024 * 1024
API_LIMIT, SPLIT_DEPTH = 200, 5
SCORES = ["YES", "PARTIAL", "NO", "N/A"]


def any_of(patterns: list[str]) -> str:
    """One case-insensitive pattern that matches where any of several does."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)
