"""Fixed values that must equal the reference system's for equal results.

Kept together, in their natural order, as plain text.
"""

# --- fixed values: configuration defaults -----------------------------------
UTILITY_KEYWORDS = ["fixed", "solved", "solution", "worked", "thank you", "step by step", "helped"]
MIN_UPVOTE_THRESHOLD = 10
K_RECALL = 50
ALPHA = 0.2
TOP_K = 10
VAL_SPLIT = 0.15
EPOCHS = 10
MODEL_VERSION = "1.0.1"
EXTRA_FEATURE_DIM = 2

# --- fixed values: feature normalisation -----------------------------------
# shipped parameters (expertise_min, expertise_max, utility_min, utility_max)
SHIPPED_NORM_PARAMS = {"expertise_min": 0.102, "expertise_max": 0.95, "utility_min": 0.002, "utility_max": 0.996}
# parameters used when no file exists
DEFAULT_NORM_PARAMS = {"expertise_min": 0.0, "expertise_max": 1.0, "utility_min": 0.0, "utility_max": 1.0}
# ranges used by the fit when a column is all-missing or constant
DEGENERATE_EXPERTISE_RANGE = (0.0, 1000.0)
DEGENERATE_UTILITY_RANGE = (0.0, 2.0)
EPS_SERVE = 1e-6
EPS_TRAIN = 1e-10
EPS_LIFT = 1e-9
LAYER_NORM_EPS = 1e-5

# --- fixed values: BM25 (Lucene defaults) -----------------------------------
BM25_K1 = 1.2
BM25_B = 0.75

# --- fixed values: evaluation ----------------------------------------------
PROXY_RELEVANT_TOP = 10          # the 10th score is the relevance threshold
MIN_HITS_PER_QUERY = 2           # queries with fewer hits are skipped
LATENCY_PERCENTILE = 0.99
IMBALANCE_SEVERE = 10.0
LOW_VARIANCE_STD = 0.1
CANARY_RELEVANT_MIN = 0.5
CANARY_DEFAULT_MIN = 0.3
SCALE_MISMATCH_AVG = 10.0

# --- fixed values: query syntax ---------------------------------------------
# characters escaped with a backslash before a query is sent to the engine
QUERY_METACHARACTERS = '+ - ! ( ) { } [ ] ^ " ~ * ? : \\ /'

# --- fixed values: analysis resources ---------------------------------------
# English stop list of the declared English text type, in file order
STOPWORDS_EN = [
    "stopworda", "stopwordb", "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if",
    "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their",
    "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
# synonym rules, in file order (equivalence groups and one-way "=>" rules)
SYNONYM_RULES = [
    "aaafoo => aaabar",
    "bbbfoo => bbbfoo bbbbar",
    "cccfoo => cccbar cccbaz",
    "fooaaa,baraaa,bazaaa",
    "GB,gib,gigabyte,gigabytes",
    "MB,mib,megabyte,megabytes",
    "Television, Televisions, TV, TVs",
    "pixima => pixma",
]
# elided articles stripped before an apostrophe, per language
ELISION_ARTICLES = {
    "fr": ["l", "m", "t", "qu", "n", "s", "j", "d", "c", "jusqu", "quoiqu", "lorsqu", "puisqu"],
    "ca": ["d", "l", "m", "n", "s", "t"],
    "it": ["c", "l", "all", "dall", "dell", "nell", "sull", "coll", "pell", "gl", "agl", "dagl",
           "degl", "negl", "sugl", "un", "m", "t", "s", "v", "d"],
    "ga": ["d", "m", "b"],
}

# --- fixed values: diagnosis canaries (query, document, expertise, utility) --
CANARIES = [
    ("relevant_high_features",
     "How to fix Python import error",
     "To fix Python import errors, make sure your PYTHONPATH is set correctly and the module is "
     "installed. Use pip install to add missing packages.",
     0.8, 0.9),
    ("irrelevant_low_features",
     "How to train neural networks",
     "I love pizza and my favorite topping is pepperoni. Yesterday I went to the movies.",
     0.1, 0.1),
    ("relevant_default_features",
     "Python error handling best practices",
     "When handling errors in Python, use try-except blocks. Catch specific exceptions rather than "
     "bare except. Log errors for debugging.",
     0.5, 0.5),
]

# --- fixed values: synthetic posts --------------------------------------------
SYNTH_TOPICS = ["Django", "React", "PostgreSQL", "Docker", "Python", "JavaScript", "AWS",
                "Machine Learning", "REST API", "MongoDB", "Redis", "Kubernetes"]
SYNTH_QUESTION_TEMPLATES = [
    "How do I {} in {}?",
    "Best practices for {} with {}",
    "{} performance optimization tips",
    "Debugging {} issues in {}",
    "{} vs {} comparison",
    "Step by step {} tutorial",
    "{} error: how to fix?",
    "Production-ready {} setup",
]
SYNTH_CODE_SNIPPETS = [
    "```python\ndef example():\n    return True\n```",
    "```javascript\nconst api = async () => { return data; }\n```",
    "<code>SELECT * FROM users WHERE active=true</code>",
    "docker run -d -p 8080:80 nginx",
]
SYNTH_SOLUTION_PHRASES = [
    "This fixed the issue for me:",
    "Solved! Here's what worked:",
    "Step by step solution:",
    "After debugging, I found:",
    "The key was to:",
]
SYNTH_HIGH_BODY = ("{phrase}\n\nWhen working with {t1}, you need to consider {t2}. \n\n{snippet}\n\n"
                   "This approach handles edge cases and is production-tested.")
SYNTH_LOW_BODY = "I'm having issues with {t1}. Has anyone tried this? Any help would be appreciated."
SYNTH_HIGH_RANGES = ((0.6, 0.95), (0.7, 1.0))   # expertise, utility
SYNTH_LOW_RANGES = ((0.1, 0.5), (0.0, 0.4))
SYNTH_SOLUTION_PROB = 0.7                        # high posts get the solution body when random() > 0.3
SYNTH_HIGH_RATIO = 0.3
