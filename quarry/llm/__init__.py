"""Training-data operators: packing, URL filters, near-duplicates,
decontamination, token rollups, line de-duplication, WARC conversion, quality
rules, secret scans, licence scans, Merkle manifests, source mixing and
embedding whitening. Nothing else in the library imports this subpackage."""
