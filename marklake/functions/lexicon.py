"""Fixed values that results depend on: word lists, tables and patterns."""

# Words that are never concepts.
CONCEPT_STOPWORDS = [
    "about", "above", "after", "again", "against", "answer", "because", "before", "below", "between", "compare",
    "define", "describe", "during", "each", "and", "explain", "from", "give", "have", "into", "list", "marks",
    "mention", "question", "semester", "show", "state", "that", "their", "there", "these", "this", "the", "through",
    "what", "when", "where", "which", "while", "with", "write", "why", "are", "was", "were", "sem", "biology",
    "chemistry", "physics", "mathematics", "maths", "science", "subject", "exam", "test",
]
CONCEPT_BLACKLIST = [
    "a", "an", "answer", "answer_key", "answers", "are", "coverage", "concept", "concepts", "expected",
    "expected_concepts", "is", "key", "key_concepts", "keys", "metadata", "the", "was", "were", "what", "when",
    "where", "why", "important",
]
GENERIC_LABELS = [
    "criteria", "description", "feedback", "field", "fields", "json", "label", "labels", "matched", "missing",
    "property", "rubric", "schema", "score", "student", "value", "values", "topic", "topics",
]

# Concept library per domain, in the order domains are tried.
DOMAIN_CONCEPTS = {
    "biology": [
        "photosynthesis", "chlorophyll", "chloroplast", "sunlight", "carbon dioxide", "water", "glucose", "oxygen",
        "mitosis", "meiosis", "cell", "respiration", "enzyme", "protein", "dna", "organism", "plant",
    ],
    "chemistry": [
        "atom", "molecule", "reaction", "bond", "acid", "base", "electron", "proton", "neutron", "oxidation",
        "reduction", "periodic", "catalyst", "solution", "compound",
    ],
    "physics": [
        "force", "mass", "acceleration", "velocity", "energy", "work", "power", "momentum", "gravity", "wave",
        "current", "voltage", "resistance", "pressure", "motion",
    ],
    "mathematics": [
        "equation", "variable", "coefficient", "constant", "derivative", "integral", "matrix", "probability",
        "function", "graph", "theorem", "proof", "angle", "triangle", "algebra",
    ],
    "computer science": [
        "algorithm", "complexity", "data", "structure", "database", "network", "encryption", "function", "class",
        "object", "recursion", "array", "stack", "queue",
    ],
}
CONCEPT_EXPANSIONS = {
    "photosynthesis": ["photosynthesis", "sunlight", "chlorophyll", "carbon dioxide", "water", "glucose", "oxygen"],
}
SYNONYMS = {
    "carbon dioxide": ["co2", "carbon-dioxide"],
    "glucose": ["sugar"],
    "sunlight": ["light", "solar"],
    "chlorophyll": ["green pigment"],
    "oxygen": ["o2"],
    "water": ["h2o"],
    "equation": ["expression", "formula"],
    "photosynthesis": ["make food", "food making", "plants make food"],
}

# Identity patterns (applied in this order, ignoring case) and protected words.
IDENTITY_PATTERNS = [
    r"\bstudent\s*name\s*[:\-]\s*[A-Za-z .]+?(?=\s+(?:roll|id)\b|$)",
    r"\bname\s*[:\-]\s*[A-Za-z .]+?(?=\s+(?:roll|id)\b|$)",
    r"\broll\s*(?:no\.?|number)?\s*[:\-]?\s*[A-Za-z0-9_\-/]+",
    r"\bid\s*[:\-]\s*[A-Za-z0-9_\-/]+",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
]
# What a lowered text must hold for the pattern to match; none where other letters fold to it.
IDENTITY_SIGNS = ["name", "name", "roll", None, "@"]
PROTECTED_TERMS = [
    "gender", "male", "female", "caste", "religion", "hindu", "muslim", "christian", "sikh", "school", "handwriting",
    "neatness",
]

# Bias scan.
BIAS_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
IDENTITY_TRIGGERS = ["student name", "student id", "name:", "id:", "roll no"]
NEATNESS_TRIGGERS = ["neatness", "handwriting", "ugly", "messy", "scribbled", "bad handwriting", "illegible"]

# Redaction rules, in order; the third field says whether case is ignored.
REDACTED = "[REDACTED]"
REDACTION_RULES = [
    (r"(student_roll_number\s*[=:]\s*)(\S+)", "$1" + REDACTED, True),
    (r"(student_name\s*[=:]\s*)([^,=]+?)(?=\s+\w+\s*[=:]|,|$)", "$1" + REDACTED, True),
    (r"\b[A-Za-z0-9]+_[0-9a-f]{6,}\.(pdf|png|jpe?g|json)\b", REDACTED + ".$1", True),
    (r"\b[A-Z]{2,4}\d{3,10}\b", REDACTED, False),
    (r"\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}", REDACTED, False),
    (r"(Bearer\s+)[A-Za-z0-9._\-]+", "$1" + REDACTED, True),
    (
        r"([?&](?:token|key|api_key|apikey|access_token|refresh_token|id_token|auth|authorization|secret|password"
        r"|signature|sig)=)[^&\s]+",
        "$1" + REDACTED,
        True,
    ),
]
ROLL_TOKEN = r"(?<![A-Za-z0-9])[A-Za-z]{2,4}\d{2,10}(?![A-Za-z0-9])"

# Rubric word lists.
RUBRIC_COMMON_WORDS = ["should", "would", "process", "result", "using", "occurs", "cells", "plants", "identical"]
RUBRIC_FUNCTION_WORDS = ["the", "a", "an", "and", "or", "in", "to", "of", "is", "are"]
EVIDENCE_COMMON_WORDS = [
    "should", "would", "could", "about", "using", "where", "which", "their", "there", "these", "those", "being",
    "coverage", "expected", "concept",
]

# Negation terms of the factual penalty, depth thresholds in words.
CONTRADICTION_TERMS = ["not", "never", "opposite", "incorrect", "untrue"]
DEPTH_WORDS = {"brief": 8.0, "conceptual": 25.0, "detailed": 60.0}

# Question classes, first hit wins.
ANSWER_TYPES = [
    ("COMPARATIVE", ["compare", "contrast", "distinguish", "difference"]),
    ("NUMERICAL", ["solve", "calculate", "find", "evaluate"]),
    ("SHORT_ANSWER", ["define", "what is", "state"]),
    ("LIST", ["list", "name", "mention"]),
]
PROMPT_TYPES = [
    ("comparison", ["compare", "contrast", "difference between", "distinguish", "difference"]),
    ("diagram", ["draw", "diagram", "label", "sketch", "graph", "plot"]),
    ("numerical", ["calculate", "solve", "evaluate", "find the value", "compute", "equation"]),
    ("list", ["list", "name", "state", "enumerate", "give 3", "give 5", "mention"]),
    ("definition", ["define", "what is", "what are", "meaning of", "definition"]),
]
INTENT_TEXTS = {
    "comparison": "Compare and contrast concepts related to: ",
    "definition": "Define and explain the meaning of: ",
    "numerical": "Perform calculations or solve mathematical problem for: ",
    "list": "Enumerate or list items/characteristics of: ",
    "diagram": "Sketch and label a diagram demonstrating: ",
    "explanation": "Explain the mechanisms or details concerning: ",
}
TOPIC_INDICATORS = [
    ("Biology", ["mitosis", "meiosis", "photosynthesis", "chloroplast", "cell", "organelle", "chlorophyll", "plant"]),
    ("Chemistry", ["reaction", "element", "molecule", "bond", "periodic", "acid", "base", "ph"]),
    (
        "Mathematics",
        ["solve", "equation", "x =", "y =", "calculus", "limit", "integral", "derivative", "algebra"],
    ),
    ("Physics", ["force", "energy", "velocity", "gravity", "mass", "motion", "wave", "optics"]),
]
PROMPT_STOPWORDS = [
    "what", "is", "are", "the", "a", "an", "and", "or", "but", "if", "then", "of", "to", "in", "on", "at", "by",
    "for", "with", "about", "against", "during", "before", "after", "above", "below", "from", "up", "down", "out",
    "over", "under", "again", "further", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "define", "explain", "compare",
    "list", "describe", "contrast", "distinguish", "calculate", "solve", "find", "sketch", "draw", "label",
    "identify", "meaning",
]

# Words that end a line as complete words when lines are rejoined.
LINE_END_WORDS = [
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can",
    "come", "could", "day", "do", "even", "first", "for", "from", "get", "give", "go", "good", "had", "has", "have",
    "he", "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "know", "like", "look",
    "make", "many", "me", "more", "most", "my", "no", "not", "now", "of", "on", "one", "only", "or", "other", "our",
    "out", "over", "people", "said", "say", "see", "she", "so", "some", "take", "than", "that", "the", "their",
    "them", "then", "there", "these", "they", "think", "this", "time", "to", "two", "up", "us", "use", "want", "was",
    "way", "we", "well", "were", "what", "when", "which", "who", "will", "with", "would", "year", "you", "your",
]
LINE_JOIN_PREFIXES = ["import", "micro", "multi", "sub"]

# Stopwords of the scheme-against-paper check.
PAPER_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "give", "how", "in", "into",
    "is", "it", "its", "list", "of", "on", "one", "or", "the", "their", "them", "there", "these", "they", "this",
    "to", "two", "use", "used", "uses", "using", "was", "what", "when", "where", "which", "why", "will", "with",
    "you", "your", "vs", "versus", "such", "following", "any", "also", "between", "about", "above", "over", "under",
]

# Study topics and instructions for single concepts.
CONCEPT_INSTRUCTIONS = {
    "chlorophyll": "Explain how chlorophyll captures sunlight during photosynthesis.",
    "carbon dioxide": "Describe how carbon dioxide is used to form glucose during photosynthesis.",
    "sunlight": "Show how sunlight provides the energy needed for the process.",
}
STUDY_TOPICS = {
    "photosynthesis": "Photosynthesis Process",
    "chlorophyll": "Role of Chlorophyll",
    "sunlight": "Light Energy In Photosynthesis",
    "carbon dioxide": "Carbon Dioxide Utilization",
    "water": "Reactants In Photosynthesis",
    "glucose": "Glucose Formation",
    "oxygen": "Oxygen Release",
}
PHOTOSYNTHESIS_TOPICS = [
    "Photosynthesis Process", "Role of Chlorophyll", "Stages of Photosynthesis", "Carbon Dioxide Utilization",
]
