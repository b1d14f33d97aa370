"""What spans several jobs: ordered numbering, the materialised cache."""
