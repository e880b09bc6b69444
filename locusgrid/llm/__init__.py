"""Operations on training corpora: filters, near-duplicates, search, packing, archives, chat."""
