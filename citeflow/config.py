"""Fixed values.

Values that must equal the original application's for equal results are kept
here, plainly and together. Everything else is a function argument.
"""

from __future__ import annotations

import datetime as _dt

# --- fixed values: recall scoring -------------------------------------------
DISTANCE_START_DATE = "2000-01-01"   # day zero of the date part of the score
DISTANCE_DAYS_PER_STEP = 12          # one score step per 12 days since day zero
CITATION_CAP = 8000                  # citations above this count as 8000
SCORE_SCALE = 10000                  # distance = exp(score / 10000 - 1)

# --- fixed values: recall list sizes and labels -----------------------------
RECALL_HIGH = 25                     # highly cited papers per list
RECALL_LATEST = 25                   # latest papers per list
COAUTHOR_TOP = 10                    # collaborators expanded per scholar
SIMILAR_TOP = 10                     # similar scholars expanded per scholar
LABEL_FOLLOWED = "followed_scholar"
LABEL_COOPERATION = "cooperation_scholar"
LABEL_SIMILAR = "similar_scholar"
LABEL_ORDER = {LABEL_FOLLOWED: 0, LABEL_COOPERATION: 1, LABEL_SIMILAR: 2}
POOL_HIGH = "high"
POOL_LATEST = "latest"
RETENTION_DAYS = 3                   # dated recall outputs kept

# --- fixed values: spans (days) ---------------------------------------------
ACTIVE_SPAN_DAYS = 30
LATEST_SPAN_DAYS = 90
NEWEST_SPAN_DAYS = 7
SEARCH_SPAN_DAYS = 365

# --- fixed values: search and labelling -------------------------------------
SEARCH_TOPK = 10
DATA_KINDS = ("paper", "topic", "report")    # of recommended data
SEARCH_NPROBE = 10
LABEL_TOPK = 2

# --- fixed values: text models ----------------------------------------------
LSA_MAX_DF = 0.5
LSA_MIN_DF = 2
LSA_MAX_FEATURES = 10000
LSA_COMPONENTS = 100
W2V_VECTOR_SIZE = 300
W2V_WINDOW = 5
W2V_MIN_COUNT = 5
W2V_PASSES = 5
W2V_PARTITIONS = 8                   # part of the model: it decides the vectors
MIXED_LSA_COMPONENTS = 200

# Stop words of the keyword-vector cleaner, in their original order.
STOPWORDS_EN = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "d", "ll", "m",
    "o", "re", "ve", "y", "ain", "aren", "couldn", "didn", "doesn", "hadn", "hasn", "haven", "isn",
    "ma", "mightn", "mustn", "needn", "shan", "shouldn", "wasn", "weren", "won", "wouldn",
)

# --- fixture constants (FIXTURES.md section 2) ------------------------------
AS_OF = _dt.date(2001, 8, 1)          # last order date = run date of the fixtures
HIGH_MIN_CITATIONS = 180
ACTIVE_END = _dt.date(2024, 1, 31)
ACTIVE_START = ACTIVE_END - _dt.timedelta(days=ACTIVE_SPAN_DAYS)
