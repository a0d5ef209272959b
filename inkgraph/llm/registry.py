"""The queries of this folder by name, and their SQL where it can express them."""

from . import align, chat, decontamination, embeddings, langid, licenses, lines, mixing, periodic, quality, sharding, simhash, tokenfiles

QUERIES = {
    "op1_licenses": licenses.query,
    "op2_line_dedup": lines.query,
    "op3_langid": langid.query,
    "op4_mixing": mixing.query,
    "op5_chat": chat.query,
    "op6_decontamination": decontamination.query,
    "op7_simhash_dedup": simhash.query,
    "op8_embedding_dedup": embeddings.query,
    "op9_quality": quality.query,
    "op10_sharding": sharding.query,
    "op11_token_files": tokenfiles.query,
    "op12_periodic_runs": periodic.query,
    "op13_alignment": align.query,
}
ORACLE_SQL = {"op1_licenses": licenses.SQL, "op4_mixing": mixing.SQL, "op5_chat": chat.SQL, "op6_decontamination": decontamination.SQL, "op10_sharding": sharding.SQL}
