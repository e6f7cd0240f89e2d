"""Writers: dimension upserts and statistics tables (topics: sources.topics)."""
