"""Operations of a training-data pipeline: language, quality, near copies, repeated text, mixing and token files."""
