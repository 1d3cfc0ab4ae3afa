"""Every default of the engine, in one place."""

TOP_K = 10
POOL = 100
RRF_K = 60
BM25_K1, BM25_B = 1.5, 0.75
ALPHA_SYMBOL, ALPHA_TEXT = 0.3, 0.5
RELATED_POOL = 5
RELATED_BOOST = {1: 1.40, 2: 1.20}
COHERENCE = 0.2
PRIOR_WEIGHT, PRIOR_POOL = 1.0, 40
DEFINITION_BOOST, STEM_FACTOR, EMBEDDED_SCALE = 3.0, 1.5, 0.5
KEYWORD_RATIO, PREFIX_LETTERS, STEM_LETTERS = 0.10, 3, 4
DECAY = 0.5
CHUNK_BYTES, OUTLINE_BYTES, EMBED_BYTES = 1500, 3000, 6000
INDEX_FILE_BYTES, PATTERN_FILE_BYTES = 2_000_000, 5 * 1024 * 1024
MEMBER_CAP, SHOW_LIMIT, LIMIT = 50, 20, 200
CALL_DEPTH, DEP_DEPTH, PATH_DEPTH, IMPACT_DEPTH, CLOSURE_DEPTH, SURFACE_DEPTH = 1, 3, 12, 2, 8, 16
CYCLE_SIZE = 2
BUDGET_TOKENS, BYTES_PER_TOKEN = 8000, 4
COMPACT_RATIO = 0.30
#: Edges of a graph that may be walked on the driver; a larger one is walked by joins.
SMALL_GRAPH = 200_000
#: Rows of a frontier that are sent to all tasks of the edges; more are sorted with them.
SIDE_ROWS = 50_000
