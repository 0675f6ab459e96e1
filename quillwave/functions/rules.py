"""Rule tables of the text functions. All values here are fixed: results depend on them as they stand, and on their order."""

from __future__ import annotations

#: Whole words, any case.
ABBREVIATIONS = [
    ("sec", "seconds"), ("min", "minutes"), ("hr", "hours"), ("vs", "versus"), ("etc", "et cetera"),
    (r"e\.g", "for example"), (r"i\.e", "that is"), ("Hz", "hertz"), ("kHz", "kilohertz"),
]

CONTRACTIONS = [
    ("you are", "you're"), ("you will", "you'll"), ("you have", "you've"), ("we are", "we're"), ("we will", "we'll"),
    ("do not", "don't"), ("does not", "doesn't"), ("cannot", "can't"), ("can not", "can't"), ("will not", "won't"),
    ("let us", "let's"), ("it is", "it's"), ("there is", "there's"), ("that is", "that's"),
]

RESPELLINGS = [
    ("Om", "ohm"), ("Aum", "ohm"), ("vipassana", "vi-pah-sana"), ("pranayama", "prah-nah-yama"), ("metta", "meh-tah"), ("samadhi", "sah-mah-dee"),
    ("namaste", "nah-mas-tay"), ("chakra", "chah-kra"), ("kundalini", "koon-da-lee-nee"), ("mudra", "moo-drah"), ("savasana", "shah-vah-sana"),
    ("shavasana", "shah-vah-sana"), ("koan", "koh-an"), ("zazen", "zah-zen"), ("dharma", "dar-ma"), ("sangha", "sang-ha"), ("tantra", "tahn-tra"),
    ("sutra", "soo-tra"),
]

#: Word and sound; written as [word](/sound/).
SOUNDS = [
    ("chakra", "tʃɑːkɹə"), ("chakras", "tʃɑːkɹəz"), ("pranayama", "pɹɑːnəˈjɑːmə"), ("savasana", "ʃɑːˈvɑːsənə"), ("ujjayi", "uːˈdʒɑːjiː"),
    ("mantra", "ˈmɑːntɹə"), ("mantras", "ˈmɑːntɹəz"), ("namaste", "nɑːməˈsteɪ"), ("sankalpa", "sɑːŋˈkɑːlpə"), ("nidra", "ˈniːdɹə"),
    ("vipassana", "vɪˈpɑːsənə"), ("ashtanga", "ɑːʃˈtɑːŋɡə"), ("vinyasa", "vɪnˈjɑːsə"), ("shavasana", "ʃɑːˈvɑːsənə"), ("asana", "ˈɑːsənə"),
    ("asanas", "ˈɑːsənəz"), ("prana", "ˈpɹɑːnə"), ("mudra", "ˈmuːdɹə"), ("mudras", "ˈmuːdɹəz"), ("bandha", "ˈbɑːndə"), ("kundalini", "ˌkʊndəˈliːni"),
    ("samsara", "sɑːmˈsɑːɹə"), ("nirvana", "nɪɹˈvɑːnə"), ("dharma", "ˈdɑːɹmə"), ("ahimsa", "ɑːˈhɪmsə"), ("satya", "ˈsɑːtjə"), ("sutra", "ˈsuːtɹə"),
    ("sutras", "ˈsuːtɹəz"), ("samadhi", "səˈmɑːdi"), ("prajna", "ˈpɹɑːdʒnə"), ("tapas", "ˈtɑːpəs"), ("ishvara", "ˈɪʃvəɹə"), ("om", "oʊm"),
    ("aum", "ɑːuːm"), ("namaskara", "nɑːməˈskɑːɹə"),
]

LESS_STRESS = ["tension", "tense", "worry", "worries", "stress", "fear", "pain", "hurry", "thoughts", "distraction"]
MORE_STRESS = ["peace", "calm", "still", "stillness", "safe", "whole", "free", "light", "gently", "softly"]

DETERMINERS = ["the", "a", "this", "that", "your"]
SENSORY = [
    "warmth", "softness", "peace", "stillness", "calm", "gentle", "quiet", "ease", "comfort", "lightness", "heaviness", "relaxation", "serenity",
    "tingling", "floating", "waves", "glow", "radiance", "spaciousness", "openness", "tenderness", "coolness", "silence", "presence", "awareness",
]

VERBS = [
    "breathe", "exhale", "inhale", "relax", "drift", "settle", "rest", "soften", "deepen", "release", "let", "allow", "notice", "feel", "sink", "melt",
    "open", "expand", "quiet", "slow", "ground", "center", "arrive", "land", "return", "scan", "observe", "witness", "float", "dissolve", "unwind",
    "surrender", "drop", "fall", "flow", "be", "stay", "sit",
]
GERUNDS = ["letting", "allowing", "releasing", "melting", "softening", "sinking"]
BREATH_NOUNS = ["breath", "exhale", "inhale", "heartbeat", "moment", "step", "wave", "rise", "fall"]
OPENERS, OPENER_WORDS = ["With", "In", "At", "On", "Through", "For"], ["each", "this", "every", "a", "the", "your"]
CLAUSE_CONJUNCTIONS, CLAUSE_WORDS = ["and", "but", "while"], 8
BREATH_CONJUNCTIONS, BREATH_WORDS = ["and", "or", "but", "as", "while"], 12
VARIED_CONJUNCTIONS, VARIED_WORDS = ["and", "as", "while", "letting", "allowing"], 10

SHORT_SENTENCE, CHUNK_TOKENS, CEILING_TOKENS, TOKENS_PER_WORD = 4, 150, 400, 1.3
CHUNK_CHARS, CHUNK_CHARS_LONG = 250, 360
LEAST_SPEED = 0.65

UNITS = ["", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
