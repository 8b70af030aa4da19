"""Training-data operators: search, language, near duplicates, quality, privacy, chat, licences, packing, rules, tokens."""
