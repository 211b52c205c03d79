"""Training-data operators: quality rules, language-model scoring, personal data, decontamination,
line, substring and near-duplicate removal, chat formatting, importance resampling and mixing.

Nothing outside this subpackage imports it.
"""
