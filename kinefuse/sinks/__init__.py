"""Writers: raw files, sections, metadata tables, the delivered dataset."""
