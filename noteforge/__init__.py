"""noteforge: analytics and curation of note vaults and document corpora on Spark DataFrames."""
