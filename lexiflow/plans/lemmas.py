"""The lemma table of the registered queries; a user passes their own."""

# Irregular verb forms, as a lemma table that a user passes.
LEMMAS = {"is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "has": "have", "had": "have",
          "went": "go", "gone": "go", "sent": "send", "kept": "keep", "found": "find", "made": "make"}
