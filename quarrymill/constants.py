"""Constants of the index format."""

#: Most kept tokens per field, and what a token weighs in each.
FIELD_TOKEN_LIMITS = {"title": 50, "headings": 200, "body": 5000}
FIELD_WEIGHTS = {"title": 5, "headings": 3, "body": 1}
MULTI_MATCH_BONUS = 2
MAX_HEADINGS = 20
EXCERPT_CHARS, EXCERPT_MIN_CUT = 200, 100
THIN_PAGE_CHARS = 50
SHARD_PREFIX_LEN, FALLBACK_SHARD, STRATEGY = 2, "_other", "prefix2"
MAX_SHARD_TERMS = 50_000
QUERY_LIMIT, QUERY_MAX_TOKENS, MAX_SHARD_CACHE = 10, 10, 30
URL_MODES = ("pretty", "html")

#: Words that are not indexed.
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down
during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most
my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them
themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you
your yours yourself yourselves
""".split()

#: White space as web scripts have it, and a word boundary that knows ASCII words only (both as Java patterns).
WEB_SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
ASCII_BOUNDARY = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"
