"""Training-data operators: decontamination, top-k search, language models,
extraction, chat formatting, secrets, toxicity, tokenizing, near-duplicates and
language identification. Nothing else in the library imports this package."""
