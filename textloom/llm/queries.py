"""The subpackage's queries and their SQL."""

from textloom.llm import ann, bpe, centroids, exact_dedup, license_scan, mixing, ngram_jaccard, prefix_trie, quality, sharding, substring_dedup, token_files, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality": quality.op2_quality,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_nearest": ann.op5_nearest,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_sharding": sharding.op9_sharding,
    "op10_ngram_jaccard": ngram_jaccard.op10_ngram_jaccard,
    "op11_centroids": centroids.op11_centroids,
    "op12_token_files": token_files.op12_token_files,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
SQL = {"op3_license_scan": license_scan.OP3_SQL, "op4_exact_dedup": exact_dedup.OP4_SQL, "op6_url_filter": url_filter.OP6_SQL, "op8_mixing": mixing.OP8_SQL, "op10_ngram_jaccard": ngram_jaccard.OP10_SQL, "op11_centroids": centroids.OP11_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
