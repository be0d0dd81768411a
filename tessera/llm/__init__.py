"""Training-data operators: media, HTML, language, licences, dedup, packing, archives and mixing."""
