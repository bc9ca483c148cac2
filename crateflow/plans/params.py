"""Parameters of the registered page queries (what a user would pass in)."""

ARTIST_ID = 0            # artist page (exists at every scale factor)
RELEASE_ID = 0           # release page
ARTIST_SEARCH = "r#00000001"
TITLE_SEARCH = "high 1"
TOP_K = 10               # landing lists
RANDOM_N = 5             # random sample as served
PAGE_K = 100             # a page of the artist catalogue
SIMILAR_K = 25           # similar-artist list
SEED = 42
FORMAT = "Vinyl"
